"""Token-id files with a minimal perfect hash index in every shard.

The documents are sorted by key over the cluster; every task encodes its range
and cuts it into shards.  A shard file is raw little-endian ids (16 bits where
the vocabulary allows it, else 32) followed by the shard's keys, a minimal
perfect hash index (a pilot per bucket; per slot a fingerprint, the offset and
the number of ids) and a fixed-size footer, so that a document is found with
one hash, one pilot and one slot.  Shards are written by Spark's text writer,
one value a file with the closing mark as line separator: the bytes pass
unchanged, lost tasks are repeated, and any file system Spark reaches will do.

Documents lie in ascending key order (null first; rows of one key by a hash of the text,
so that a key with many rows spreads over tasks, and the index names the first of a shard).  Null and empty texts have only the end id.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.llm.common import saved, shared_path, worker_state

SHARD_IDS = 4_000_000  # a shard closes with the document that reaches it
MAX_SHARDS = 1_000_000  # of a store that keyed access serves: the manifest's bound
MARK = "TOKSHARD"
FOOTER = "<QIIIIQ"  # ids, bytes an id, documents, slots, buckets, shard number
BATCH, BATCH_BYTES = 2_000, 4_000_000  # rows that are encoded at once, and bytes of text with which a batch closes
CACHE = 1_000_000  # words of a worker's table: some 40 MB


def spans_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of ``data`` that ``which`` names, one after the other: where each begins (and the last ends), and the items."""
    count = sizes[which]
    ends = np.concatenate([[0], np.cumsum(count)])
    return ends, data[np.repeat(starts[which] - ends[:-1], count) + np.arange(ends[-1])]


class Encoder:
    """A vocabulary of the tokenizers library; words are encoded once and kept.

    The byte-level splitter always starts a piece at a blank, and puts one before and after a line
    feed, that stands between two characters that are not white space: the ids of such a text are
    those of its words, each with the blank or line feed before it.  A full stop or comma after a
    letter or digit starts a piece as well, and is held as a word of its own.  A batch is split and its words
    alike are numbered as an Arrow column, so that only different words become Python strings, and ids
    are gathered as arrays.  Missing words are encoded in
    one call, a line each, and told apart by the id of the line feed.  Texts with other white space
    next to each other, or with special tokens, go to the library whole.
    """

    def __init__(self, source: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = np.dtype(self.kind).itemsize
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        spaces = "".join(map(re.escape, (c for c in map(chr, range(0x110000)) if c.isspace() and c not in " \n")))
        self.other = re.compile(f"[{spaces}]")  # listed: searched faster than a class
        # known words, their ids one after the other, where each begins, the batch that last asked for it
        self.words, self.data, self.starts, self.used, self.batches = pa.array([], pa.large_string()), np.zeros(0, self.kind), np.zeros(1, np.int64), np.zeros(0, np.int64), 0
        self.stop, self.mixed = re.compile(r"(?<=[^\W_])([.,])"), re.compile(r"[.,](?<=[\W_][.,])")
        spec = json.loads(source)
        before = spec.get("pre_tokenizer") or {}
        self.line = self.library.encode("\n", add_special_tokens=False).ids
        self.by_word = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") \
            and not before.get("add_prefix_space") and len(self.line) == 1

    def edged(self, text: str) -> bool:
        """White space at an end, next to white space, of another kind, or before a full stop or comma."""
        return text[0].isspace() or text[-1].isspace() or any(x in text for x in ("  ", "\n\n", " \n", "\n ", " .", " ,")) or bool(self.other.search(text))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def fresh(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words without line feeds inside; a first "\\n", full stop or comma stands for itself, else a blank goes before."""
        out = {}
        stops = [w for w in words if w[0] in ".,"]
        out.update(zip(stops, self.whole(stops)))
        for starts in (True, False):
            own = [w for w in words if (w[0] == "\n") == starts and w[0] not in ".,"]
            for at in range(0, len(own), 5_000):
                some = own[at:at + 5_000]
                (e,) = self.library.encode_batch_fast(["".join(some) if starts else "\n " + "\n ".join(some)], add_special_tokens=False)
                ids = np.array(e.ids, self.kind)
                cuts = np.flatnonzero(ids == self.line[0])
                if len(cuts) != len(some):
                    raise ValueError("a word holds the id of the line feed")
                data = ids.tobytes()
                begin = ((cuts if starts else cuts + 1) * self.width).tolist()
                end = [*(cuts[1:] * self.width).tolist(), len(data)]
                out.update((w, data[b:e]) for w, b, e in zip(some, begin, end))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        out: list = [b""] * len(texts)
        whole, plain, lines = [], [], []
        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.by_word or self.edged(text) or any(s in text for s in self.special):
                whole.append(k)
                continue
            # mostly every stop follows a letter or digit, and a plain replacement does the same
            text = self.stop.sub(r" \1", text) if text[0] in ".," or self.mixed.search(text) else text.replace(".", " .").replace(",", " ,")
            lines.append("\n" + text.replace("\n", " \n"))
            plain.append(k)
        for k, found in zip(plain, self.joined(lines)):
            out[k] = found
        for k, found in zip(whole, self.whole([texts[k] for k in whole])):
            out[k] = found
        return out

    def joined(self, lines: list[str]) -> list[bytes]:
        """Ids of words that blanks part, text by text, without the line feed set before the first word."""
        if not lines:
            return []
        words = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        alike = words.flatten().dictionary_encode()
        at = pc.fill_null(pc.index_in(alike.dictionary, value_set=self.words), -1).to_numpy().astype(np.int64)
        lost = np.flatnonzero(at < 0)
        at[lost] = len(self.words) + np.arange(len(lost))
        names = alike.dictionary.take(pa.array(lost))
        listed = names.to_pylist()
        new = self.fresh(listed)
        ids = [new[w] for w in listed]
        known = pa.concat_arrays([self.words, names])
        data = np.concatenate([self.data, np.frombuffer(b"".join(ids), self.kind)])
        starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // self.width)])
        used = np.concatenate([self.used, np.zeros(len(ids), np.int64)])
        self.batches += 1
        used[at] = self.batches

        word = alike.indices.to_numpy()
        ends, found = spans_of(data, starts[at], starts[at + 1] - starts[at], word)
        bounds = ends[words.offsets.to_numpy()].tolist()
        self.keep(known, data, starts, used)
        return [found[b + 1:e].tobytes() for b, e in zip(bounds, bounds[1:])]

    def keep(self, words: pa.Array, data: np.ndarray, starts: np.ndarray, used: np.ndarray) -> None:
        """Holds words and ids for later batches: no long words, and beyond ``CACHE`` words the half asked for last."""
        short = pc.binary_length(words).to_numpy() <= 256
        if not short.all() or len(words) > CACHE:
            stay = np.flatnonzero(short)
            if len(stay) > CACHE:
                stay = np.sort(stay[np.argsort(-used[stay], kind="stable")[:CACHE // 2]])
            starts, data = spans_of(data, starts[:-1], np.diff(starts), stay)
            words, used = words.take(pa.array(stay)), used[stay]
        self.words, self.data, self.starts, self.used = words, data, starts, used


def batches_of(batch: pa.RecordBatch):
    """``batch`` in slices of bounded size; the texts are its second column."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        full = int(sizes.searchsorted((sizes[at - 1] if at else 0) + BATCH_BYTES)) + 1
        end = min(at + BATCH, max(full, at + 1), len(batch))
        yield batch.slice(at, end - at)
        at = end


def hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Placement hashes and 32-bit fingerprints of keys."""
    place = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    prints = np.fromiter((xxhash.xxh32_intdigest(k, seed=7) for k in keys), np.uint32, len(keys))
    return place, prints


def slot_of(place, pilot, slots: int):
    """Slot of a key under its bucket's pilot (numbers or arrays)."""
    x = (place ^ (pilot * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) % np.uint64(slots)


def build(place: np.ndarray) -> np.ndarray:
    """Pilots (signed) of a minimal perfect hash over distinct ``place`` values; buckets of about three keys.

    Large buckets first try pilots until their keys fall on free, different slots, all buckets of one
    size at once: of several that claim a slot under one pilot the first takes it, the others
    try the next pilot.  A bucket of one key names its slot itself, as -1 - slot.
    """
    n = len(place)
    buckets = max(1, -(-n // 3))
    pilots, free = np.zeros(buckets, np.int64), np.ones(n, bool)
    bucket = (place >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    names, starts, sizes = np.unique(bucket[order], return_index=True, return_counts=True)
    claimed = np.empty(n, np.int64)
    with np.errstate(over="ignore"):
        for size in sorted(set(sizes.tolist()) - {1}, reverse=True):
            own = np.flatnonzero(sizes == size)
            members, pilot = place[order[starts[own][:, None] + np.arange(size)]], 0
            while len(own):
                pilot += 1
                at = slot_of(members, np.uint64(pilot), n).astype(np.int64)
                apart = np.sort(at, axis=1)
                able = np.flatnonzero(free[at].all(1) & (apart[:, 1:] != apart[:, :-1]).all(1))
                if not len(able):
                    continue
                number = np.repeat(np.arange(len(able)), size)
                claimed[at[able].ravel()[::-1]] = number[::-1]  # the first claim is written last
                taken = able[(claimed[at[able]] == np.arange(len(able))[:, None]).all(1)]
                free[at[taken].ravel()] = False
                pilots[names[own[taken]].astype(np.int64)] = pilot
                left = np.ones(len(own), bool)
                left[taken] = False
                own, members = own[left], members[left]
    singles = names[sizes == 1].astype(np.int64)
    pilots[singles] = -1 - np.flatnonzero(free)[:len(singles)]
    return pilots


def find(place: np.ndarray, pilots: np.ndarray, slots: int) -> np.ndarray:
    """Slots of keys: one pilot and one hash each."""
    pilot = pilots[((place >> np.uint64(33)) % np.uint64(len(pilots))).astype(np.int64)]
    with np.errstate(over="ignore"):
        hashed = slot_of(place, np.maximum(pilot, 0).astype(np.uint64), slots).astype(np.int64)
    return np.where(pilot < 0, -1 - pilot, hashed)


SLOT = np.dtype([("print", "<u4"), ("rows", "<u4"), ("offset", "<u8"), ("count", "<u8")])


def pack(shard: int, keys: list[str | None], payloads: list[bytes], kind: str) -> bytes:
    """A shard file without its closing mark."""
    names = [b"" if k is None else str(k).encode() for k in keys]
    counts = np.array([len(p) for p in payloads], np.int64) // np.dtype(kind).itemsize
    offsets = np.concatenate([[0], np.cumsum(counts)])
    first = [i for i, k in enumerate(names) if not i or names[i - 1] != k]  # equal keys are neighbours
    place, prints = hashes([names[i] for i in first])
    if len(np.unique(place)) < len(place):
        raise ValueError("two keys of a shard share a 64-bit hash")
    pilots = build(place)
    table = np.zeros(len(first), SLOT)
    at = find(place, pilots, len(first))
    table["print"][at], table["offset"][at] = prints, offsets[first]
    table["rows"][at] = np.diff([*first, len(names)])
    table["count"][at] = counts[first]
    listed = struct.pack(f"<{len(names)}I", *map(len, names)) + b"".join(names) + counts.astype("<u8").tobytes()
    return b"".join([*payloads, listed, table.tobytes(), pilots.astype("<i8").tobytes(), struct.pack("<I", len(listed)),
                     struct.pack(FOOTER, int(offsets[-1]), np.dtype(kind).itemsize, len(names), len(first), len(pilots), shard)])


class Shard:
    """A shard file's content, read in place."""

    def __init__(self, data) -> None:
        view = memoryview(data)
        if bytes(view[-len(MARK):]) != MARK.encode():
            raise ValueError("not a whole shard file")
        end = len(view) - len(MARK) - struct.calcsize(FOOTER)
        self.total, width, self.docs, slots, buckets, self.number = struct.unpack_from(FOOTER, view, end)
        (listed,) = struct.unpack_from("<I", view, end - 4)
        self.ids = np.frombuffer(view, f"<u{width}", self.total)
        self.pilots = np.frombuffer(view, "<i8", buckets, end - 4 - 8 * buckets)
        self.table = np.frombuffer(view, SLOT, slots, end - 4 - 8 * buckets - SLOT.itemsize * slots)
        at = self.total * width
        lengths = struct.unpack_from(f"<{self.docs}I", view, at)
        self.counts = np.frombuffer(view, "<u8", self.docs, at + listed - 8 * self.docs)
        at += 4 * self.docs
        self.keys = []
        for n in lengths:
            self.keys.append(bytes(view[at:at + n]))
            at += n

    def spans(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, first offset, ids) of keys through the index."""
        if not len(self.table) or not keys:
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        place, prints = hashes(keys)
        row = self.table[find(place, self.pilots, len(self.table))]
        return row["print"] == prints, row["offset"].astype(np.int64), row["count"].astype(np.int64)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, key: str = "doc_id", text: str = "text",
          shard_ids: int = SHARD_IDS) -> None:
    """Shard files of all rows of ``docs`` under ``path``."""
    with open(vocabulary, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary: a fixed size
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("key", "h").sortWithinPartitions("key", "h", "text")
    rows = rows.select(F.col("key").cast("string"), "text")

    def run(batches):
        encoder = worker_state("ids_" + hashlib.sha1(source.value.encode()).hexdigest(), lambda: Encoder(source.value))
        part, k, keys, payloads, size = TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            for some in batches_of(batch):
                names, texts = (c.to_pylist() for c in some.columns)
                for name, ids in zip(names, encoder.encode([t or "" for t in texts])):
                    keys.append(name)
                    payloads.append(ids + end)
                    size += len(payloads[-1])
                    if size >= shard_ids * len(end):
                        yield pa.RecordBatch.from_arrays([pa.array([pack(part << 24 | k, keys, payloads, encoder.kind)], pa.binary())], ["value"])
                        k, keys, payloads, size = k + 1, [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([pack(part << 24 | k, keys, payloads, encoder.kind)], pa.binary())], ["value"])

    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", MARK).option("maxRecordsPerFile", 1).text(path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(shard, key, first, offset, n, crc, total) of every document, each found through its shard's index."""
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                s = Shard(batch.column(0)[i].as_buffer())
                found, offset, count = s.spans(s.keys)
                # Rows after the first of a key follow it.
                again = np.array([i > 0 and s.keys[i - 1] == k for i, k in enumerate(s.keys)], bool)
                starts = np.concatenate([[0], np.cumsum(s.counts.astype(np.int64))[:-1]])
                sizes = np.where(again, s.counts.astype(np.int64), count)
                starts = np.where(again, starts, offset)
                if not found.all():
                    raise ValueError("a shard's index does not know its keys")
                crc = [zlib.crc32(s.ids[a:a + n].astype("<u4").tobytes()) for a, n in zip(starts, sizes)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([s.number] * s.docs, pa.int64()), pa.array([k.decode() or None for k in s.keys], pa.string()),
                    pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()),
                    pa.array([s.total] * s.docs, pa.int64())], ["shard", "key", "offset", "n", "crc", "total"])

    return _shards(spark, path).mapInArrow(run, "shard bigint, key string, offset bigint, n bigint, crc bigint, total bigint")


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ids) of the keys that the store holds: the shard by its key range, the span by its index."""
    kind = keys.schema[key].dataType
    known = read(spark, path).select("shard", F.col("key").cast(kind).alias("key"))
    manifest = known.groupBy("shard").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low IS NOT NULL") \
        .orderBy("low", "shard").limit(MAX_SHARDS + 1).collect()
    if len(manifest) > MAX_SHARDS:
        raise ValueError(f"more than {MAX_SHARDS} shards: write larger ones")
    lows, highs, numbers = ([r[k] for r in manifest] for k in ("low", "high", "shard"))

    def place(batches):
        for batch in batches:
            out = []
            for k in batch.column(0).to_pylist():
                at = bisect.bisect_right(lows, k) - 1
                while at >= 0 and highs[at] >= k:
                    out.append((numbers[at], str(k)))
                    at -= 1
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], ["shard", "key"])

    asked = keys.select(F.col(key)).where(F.col(key).isNotNull()).distinct().mapInArrow(place, "shard bigint, key string")

    def numbered(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([Shard(batch.column(0)[i].as_buffer()).number for i in range(len(batch))], pa.int64()), batch.column(0)], ["shard", "content"])

    def fetch(batches):
        for batch in batches:
            for shard, own in zip(batch.column("content"), batch.column("asked").to_pylist()):
                s = Shard(shard.as_buffer())
                found, offset, count = s.spans([k.encode() for k in own])
                yield pa.RecordBatch.from_arrays([pa.array([k for k, f in zip(own, found) if f], pa.string()),
                                                  pa.array([s.ids[a:a + n].tolist() for a, n, f in zip(offset, count, found) if f], pa.list_(pa.int64()))], ["key", "ids"])

    shards = _shards(spark, path).mapInArrow(numbered, "shard bigint, content binary")
    per_shard = asked.groupBy("shard").agg(F.collect_list("key").alias("asked"))  # at most a shard's keys
    out = shards.join(per_shard, "shard").select("content", "asked").mapInArrow(fetch, "key string, ids array<bigint>")
    return out.select(F.col("key").cast(kind).alias(key), "ids")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files in the shared folder."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-ids")
    write(docs, path, vocabulary)
    rows = saved(read(spark, path), "token-spans")
    total = rows.where("offset = 0").groupBy("shard").agg(F.max("total").alias("total"))  # one row a shard
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = total.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(starts, "shard").select(F.col("key").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
                                             (F.col("before") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
