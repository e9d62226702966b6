"""Byte-pair encoding and decoding with a public vocabulary, by a contiguous rank array.

A word is held as its list of parts and a second list with the rank of every
adjacent pair; the smallest rank is looked up by a scan, its boundary deleted
and the two neighbouring ranks refreshed.  That is quadratic in the word but
fastest for the short words that texts have; words beyond ``SCAN`` parts use a
heap over the same pairs, with the same result.  A worker keeps the ids of the
words it met lately.

The vocabulary file (the JSON of the tokenizers library: BPE with an end mark
on words, bytes spelled as letters) is read by the driver and sent to the
tasks; its size does not depend on the data.  Null and empty texts have no ids.
Every row keeps its row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import Kept, worker_state

SCAN = 64
WORDS, KEPT_PIECES = 300_000, 150_000  # entries of a generation of the worker's caches
NONE = 1 << 62
BATCH = 500  # rows handed back at once

# White space and contractions as the vocabulary's normaliser and splitter name them.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"


def category(initial: str) -> str:
    """The characters of a general category, as ranges of a character class."""
    codes = np.array([c for c in range(0x110000) if unicodedata.category(chr(c))[0] == initial])
    starts = codes[np.diff(codes, prepend=-2) != 1]
    ends = codes[np.diff(codes, append=0x110001) != 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


def byte_letters() -> list[str]:
    """The letter that spells each byte: itself if printable in Latin-1, else the next beyond 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Model:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        self.vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.token = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        # (left, right) -> rank and merged id in one number, so that the smallest number is the smallest rank
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.pair = {(self.vocab[a], self.vocab[b]): (rank << 32) | self.vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.inner = [self.vocab.get(c) for c in letters]
        self.final = [self.vocab.get(c + end) for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        letters, digits = category("L"), category("N")
        self.pieces = re.compile(f"{SHORT}|[{letters}]+|[{digits}]|[^{SPACE}{letters}{digits}]+")
        self.space, self.odd = re.compile(f"[{SPACE}]+"), re.compile("[\x1c-\x1f]")
        self.words, self.known = Kept(WORDS), Kept(KEPT_PIECES)

    def merge(self, parts: list[int]) -> list[int]:
        if len(parts) > SCAN:
            return self.merge_long(parts)
        get = self.pair.get
        ranks = [get(p, NONE) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            parts[i] = best & 0xFFFFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NONE)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.pair.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:])) if (r := get(p, NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or get((parts[i], parts[j]), NONE) != rank:
                continue
            parts[i], alive[j], after[i] = rank & 0xFFFFFFFF, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := get((parts[a], parts[b]), NONE)) != NONE:
                    heapq.heappush(heap, (r, a))
        return [p for p, keep in zip(parts, alive) if keep]

    def piece(self, piece: str) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            data = piece.encode()
            parts = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
            ids = self.merge([p for p in parts if p is not None])
            if len(data) <= SCAN:
                self.known.put(piece, ids)
        return ids

    def word(self, word: str) -> bytes:
        """Ids (little-endian, 32 bits) of a run without white space."""
        ids = self.words.get(word)
        if ids is None:
            ids = array("I", [i for piece in self.pieces.findall(word) for i in self.piece(piece)]).tobytes()
            if len(word) <= SCAN:
                self.words.put(word, ids)
        return ids

    def plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter, no final form
        words = self.space.sub(" ", text).split(" ") if self.odd.search(text) else text.split()
        young, out = self.words.young, []
        for w in words:
            ids = young.get(w)
            if ids is None:
                ids, young = self.word(w), self.words.young
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.cut is None or "<|" not in text:
            return self.plain(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self.plain(x) for x in self.cut.split(text))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _each(rows: DataFrame, vocabulary: str, value: str, steps: list, keep: bool = True) -> DataFrame:
    """``rows`` with a column per step (name, type, function of the model and the values before), in one pass."""
    with open(vocabulary, encoding="utf-8") as f:
        source = rows.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary: a fixed size

    def run(batches):
        name = "bpe_" + hashlib.sha1(source.value.encode()).hexdigest()
        model = worker_state(name, lambda: Model(source.value))
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.slice(at, BATCH)
                values = part.column(value).to_pylist()
                part = part.select(kept)
                for out, kind, work in steps:
                    values = work(model, values)
                    part = part.append_column(out, pa.array(values, pa.binary() if kind == "binary" else pa.string()))
                yield part

    kept = [c for c in rows.columns if keep or c != value]
    schema = [f"`{c}` {t}" for c, t in rows.dtypes if c in kept] + [f"`{out}` {kind}" for out, kind, _ in steps]
    return rows.mapInArrow(run, ", ".join(schema))


def _ids(m: Model, values: list) -> list:
    return [m.encode(v) if v else b"" for v in values]


def _text(m: Model, values: list) -> list:
    return [m.decode(v) if v else "" for v in values]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` (little-endian, 32 bits each) in ``out``."""
    return _each(docs, vocabulary, text, [(out, "binary", _ids)])


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids`` in ``out``."""
    return _each(rows, vocabulary, ids, [(out, "string", _text)])


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` without ``text`` but with its ids and their text: one worker holds the model for both."""
    return _each(docs, vocabulary, text, [(ids, "binary", _ids), (out, "string", _text)], keep=False)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    rows = encode_decode(docs.select("doc_id", F.col("text").cast("string").alias("text")), vocabulary)
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
