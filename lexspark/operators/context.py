"""Word-and-context examples (X1-X14): one source/target pair per word.

Words travel to their sentence packed (``operators.packed``), without their units;
these are only cut where the words are laid out one behind the other.  A chunk of
words is then rendered at once: its words' pieces are one text with the offsets of
all units, and a word's left and right context are two slices of it, so a word costs
its context and no more.  A chunk holds as many words to either side as a context can
reach, so no sentence is one row.

Context rule: walking away from the focus word take the first k units
(unit budget) or all units whose cumulative length is <= N (character
budget; a unit that does not fit stops the walk), restore text order, put
the word boundary between units of different words, none at either end.
With ``context_tags='left'`` every word at least partly present in the
left context is followed by the tag boundary and its tag units.
"""

from __future__ import annotations

from typing import Optional

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.config import TransformConfig, closing_tag
from lexspark.functions.arrays import units_of
from lexspark.functions.joins import skew_join
from lexspark.functions.utf8 import Pool, bytes_of, glued, spelled, strings_of
from lexspark.operators.clean import drop_incomplete
from lexspark.operators.packed import BLOCK, CHUNK, Chunk, cuts, laid_out, pack

SENT = ("part", "doc_id", "sent_no")
TEXT = 1 << 21  # bytes of contexts that leave a task in one batch


def with_units(tokens: DataFrame, cfg: TransformConfig, bpe_units: Optional[DataFrame] = None) -> DataFrame:
    """Add ``cu``, the context units of the word, where they do not follow from the word itself (BPE)."""
    if cfg.context_unit != "bpe":
        return tokens
    if bpe_units is None:
        raise ValueError("context_unit='bpe' needs a segmentation table (lexspark.operators.bpe.segment_types)")
    seg = bpe_units.select(F.col("type").alias("__ty"), F.col("units").alias("cu"))
    t = skew_join(tokens.withColumn("__ty", F.col("word")), seg, ["__ty"], "left").drop("__ty")
    return t.withColumn("cu", F.coalesce(F.col("cu"), units_of(F.col("word"), "char")))


def budget_of(cfg: TransformConfig) -> Optional[int]:
    """Units (and so words) that a context can reach to one side; None: the whole sentence."""
    if cfg.context_char_size is not None:
        return max(cfg.context_char_size, 0)
    return None if cfg.context_size is None or cfg.context_size < 0 else cfg.context_size


def blocks(t: DataFrame, w, sent, budget: Optional[int], block: int) -> DataFrame:
    """Words with the block ``slot`` that they are laid out in; ``own`` is false where a word only serves as context.

    ``w``: window of a sentence in the order of its words.  The last block also
    holds what is left over, so every block but the only one has ``2 * budget`` words or more.
    """
    if budget is None:
        return t.withColumn("slot", F.lit(0)).withColumn("own", F.lit(True))
    size = max(block, 2 * budget, 1)
    t = t.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*sent)))
    last = F.greatest(F.floor(F.col("__n") / size) - 1, F.lit(0)).cast("int")  # what is left over belongs to the last block
    b = F.least(F.floor(F.col("__i") / size).cast("int"), last)
    at = F.col("__i") - b * size
    place = lambda slot, own: F.struct(slot.alias("slot"), F.lit(own).alias("own"))
    places = F.when(last == 0, F.array(place(b, True))).otherwise(F.filter(F.array(
        place(b, True), F.when((b < last) & (at >= size - budget), place(b + 1, False)),
        F.when((b > 0) & (at < budget), place(b - 1, False))), lambda x: x.isNotNull()))
    return t.select(*[c for c in t.columns if c not in ("__i", "__n")], F.inline(places))


def sentence_units(tokens_u: DataFrame, sent=SENT, budget: Optional[int] = None, block: int = BLOCK) -> DataFrame:
    """One row per sentence and block: its words in order (``ws``); the builder itself lays out packed words.

    A sentence is cut into blocks of ``block`` words, the last one of up to twice as many.  Every block also holds the
    words of its neighbours that a context can reach (``own`` is false there): a word
    has at least one unit and one character, so ``budget`` words to either side are
    enough.  Sentences of up to ``block`` words are one block, number 0; without a
    budget contexts span the sentence and so does its block.
    """
    s = list(sent)
    fields = ["word_no", "word", "lemma", "tag", *(["cu"] if "cu" in tokens_u.columns else [])]
    t = blocks(tokens_u.select(*s, *fields), Window.partitionBy(*s).orderBy("word_no"), s, budget, block)
    return t.groupBy(*s, "slot").agg(F.sort_array(F.collect_list(F.struct(*fields, "own"))).alias("ws"))


class Units:
    """The context units of all words of a chunk, one after the other, as arrays.

    ``first``: number of the first unit of every word, and of the end; ``of``: word of a unit; ``size``: its characters;
    ``inside`` / ``nth``: characters and units of the word before it; ``row_from`` / ``row_to``: units that a word's context may span.
    """

    def __init__(self, chunk: Chunk, unit: str, n: int) -> None:
        texts = self.texts = chunk.words.texts
        self.words = texts["word"]
        self.length = pc.utf8_length(self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        if unit == "bpe":
            cu = texts["cu"]
            number = pc.list_value_length(cu).to_numpy(zero_copy_only=False).astype(np.int64)
            self.size = pc.utf8_length(cu.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
        elif unit == "word":
            number, self.size = np.ones(len(self.length), np.int64), self.length
        else:
            number = -(-self.length // n)
            self.size = np.full(number.sum(), n, np.int64)
            some = number > 0
            self.size[np.cumsum(number)[some] - 1] = (self.length - n * (number - 1))[some]
        self.number = number
        self.first = np.append(0, np.cumsum(number))
        self.of = np.repeat(np.arange(len(number)), number)
        before = np.append(0, np.cumsum(self.size))
        self.inside = before[:-1] - before[self.first[self.of]]
        self.nth = np.arange(len(self.of)) - self.first[self.of]
        self.chars = before[self.first[1:]] - before[self.first[:-1]]  # of the word's units
        self.row_from, self.row_to = self.first[chunk.low], self.first[chunk.high]

    def reach(self, own: np.ndarray, k: Optional[int], N: Optional[int], concatenate: bool = True) -> tuple:
        """(lo, hi) per word of ``own``: the units of its left context start at ``lo``, those of its right one end before ``hi``.

        ``concatenate``: a word's units make up the word, so character offsets never fall.
        """
        a, b, low, high = self.first[own], self.first[own + 1], self.row_from[own], self.row_to[own]
        if N is None:
            return (low, high) if k is None or k < 0 else (np.maximum(low, a - k), np.minimum(high, b + k))
        place = np.cumsum(self.length) - self.length
        c0 = place[self.of] + self.inside
        c1 = c0 + self.size
        start, end = place[own] - N, place[own] + self.length[own] + N
        if concatenate:
            return np.clip(np.searchsorted(c0, start), low, a), np.clip(np.searchsorted(c1, end, side="right"), b, high)
        low, high = np.maximum(low, a - N), np.minimum(high, b + max(N, 0))
        lo = [x + int(np.count_nonzero(c0[x:y] < c)) for x, y, c in zip(low.tolist(), a.tolist(), start.tolist())]
        hi = [x + int(np.count_nonzero(c1[x:y] <= c)) for x, y, c in zip(b.tolist(), high.tolist(), end.tolist())]
        return np.array(lo, np.int64), np.array(hi, np.int64)


def _laid_out(u: Units, size: np.ndarray, pieces: tuple, mark: str, closing: Optional[tuple] = None) -> tuple:
    """(text, start and end of every unit in it): per word with units ``mark``, its units, ``closing`` and a blank, as bytes.

    ``size``: bytes of every unit; ``pieces``, ``closing``: (data, offsets) of the words' units with blanks between them and of what follows them.
    """
    pool, opening = Pool(), len(f"{mark} ".encode())
    own, front = pool.add(pieces[0]), pool.add(f"{mark} ")
    some = (u.number > 0).astype(np.int64)
    parts = [(front, opening * some), (own + pieces[1][:-1], np.diff(pieces[1]) * some)]
    behind = np.zeros(len(some), np.int64)
    if closing is not None:
        behind = np.diff(closing[1]) * some
        parts.append((pool.add(closing[0]) + closing[1][:-1], behind))
    parts.append((pool.add(" "), some))
    text, at = glued(pool.bytes(), len(some), *parts)
    before = np.append(0, np.cumsum(size))
    start = at[u.of] + opening + before[:-1] - before[u.first[u.of]] + u.nth
    return text, np.append(start, 0), np.append(start + size + np.where(u.nth == u.number[u.of] - 1, behind[u.of], 0), 0)


def _renderer(cfg: TransformConfig, keys, word_no: str, block: int):
    """Function of packed batches to batches (keys, word_no, source, target), a row per word."""
    wb, tb, ob, cb = cfg.word_boundary, cfg.tag_boundary, cfg.example_boundary, closing_tag(cfg.example_boundary)
    lb, rb, tags = cfg.left_context_boundary, cfg.right_context_boundary, cfg.context_tags == "left"
    unit, n, word_unit, tag_unit = cfg.context_unit, cfg.n, cfg.word_unit, cfg.tag_unit
    k, N, tag_first = cfg.context_size, cfg.context_char_size, cfg.tag_first

    def written(strings, whole):
        return bytes_of(strings) if whole else spelled(strings)[:2]

    def units(u):
        """(bytes of every unit, (data, offsets) of the words' units with blanks between them)."""
        if unit == "bpe":
            cu = u.texts["cu"]
            return pc.binary_length(cu.flatten()).to_numpy(zero_copy_only=False).astype(np.int64), bytes_of(pc.binary_join(cu, " "))
        if unit == "word":
            whole = bytes_of(u.words)
            return np.diff(whole[1]), whole
        data, at, size = spelled(u.words, n)
        return size, (data, at)

    def marked(strings, mark):
        """(data, offsets) of the strings behind a mark."""
        pool, (data, at) = Pool(), strings
        own, front = pool.add(data), pool.add(mark)
        return glued(pool.bytes(), len(at) - 1, (front, len(mark.encode())), (own + at[:-1], np.diff(at)))

    def render(chunk):
        u, own = Units(chunk, unit, n), chunk.own
        size, pieces = units(u)
        right_text, *right_at = left_text, *left_at = _laid_out(u, size, pieces, wb)
        if tags:
            left_text, *left_at = _laid_out(u, size, pieces, wb, marked(written(u.texts["tag"], tag_unit == "word"), f" {tb} "))
        lo, hi = u.reach(own, k, N, unit != "bpe")
        a, b = u.first[own], u.first[own + 1]
        # a context opens with a unit, without the boundary before it
        l0, l1 = np.where(lo < a, left_at[0][lo], 0), np.where(lo < a, left_at[1][a - 1], 0)
        r0, r1 = np.where(b < hi, right_at[0][b], 0), np.where(b < hi, right_at[1][hi - 1], 0)
        pool = Pool()

        def added(data, at):
            return pool.add(data) + at[:-1], np.diff(at)

        def mark(text):
            return pool.add(text), len(text.encode())

        at = pa.array(own)
        word, lemma, tag = (added(*written(u.texts[c].take(at), whole == "word")) for c, whole in (("word", word_unit), ("lemma", word_unit), ("tag", tag_unit)))
        right = pool.add(right_text)
        left = pool.add(left_text) if tags else right
        opens, before, behind, between, closes = (mark(x) for x in (f"{ob} ", f" {lb} ", f" {rb} ", f" {tb} ", f" {cb}"))
        held = pool.bytes()
        # the blank that opens a mark goes where there is no context in front of it
        after = lambda m, some: (m[0] + ~some, m[1] - ~some)
        for start, stop in cuts(l1 - l0 + r1 - r0 + 64, TEXT):
            x = slice(start, stop)
            of = lambda p: (p[0][x], p[1][x])
            source = glued(held, stop - start, opens, (left + l0[x], (l1 - l0)[x]), after(before, l1[x] > l0[x]), of(word), behind,
                           (right + r0[x], (r1 - r0)[x]), after(closes, r1[x] > r0[x]))
            first, second = (tag, lemma) if tag_first else (lemma, tag)
            target = glued(held, stop - start, opens, of(first), between, of(second), closes)
            rows, no = pa.array(chunk.words.row[own[x]]), own[x]
            found = [chunk.rows.column(c).take(rows) for c in keys]
            if cfg.context_span > 0:
                found[-1] = found[-1].cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*found, pa.array(chunk.words.no[no], mask=~chunk.words.known[no]).cast(word_no),
                                              strings_of(*source), strings_of(*target)], [*keys, "word_no", "source", "target"])

    def run(batches):
        for chunk in laid_out(batches, keys, budget_of(cfg), cfg.context_span, block, unit == "bpe", CHUNK):
            yield from render(chunk)

    return run


def build_examples(tokens: DataFrame, cfg: TransformConfig, bpe_units: Optional[DataFrame] = None,
                   sent=SENT, as_arrays: bool = True, block: int = BLOCK) -> DataFrame:
    """(sent keys, word_no, source, target), arrays of symbols (or text with ``as_arrays=False``).

    ``tokens``: cleaned tokens with ``word, lemma, tag`` and sentence keys.
    Sentences with no words yield no example (X13); nor do rows with a missing
    word, lemma or tag, which ``clean.split_rejects`` routes to their own output.

    Per batch of sentences (once): every unit is rendered as a piece of text, with
    the word boundary in front when it opens a word and, for left-context tags,
    the tag behind when it closes one.  Per word: the context is a slice of that
    text without a leading boundary, found by the offsets of its units.
    """
    cfg.validate()
    s = list(sent)
    words = drop_incomplete(tokens).select(*s, "word_no", "word", "lemma", "tag")
    t, types = with_units(words, cfg, bpe_units), dict(tokens.dtypes)
    if cfg.context_span > 0 and cfg.exclude_last_right:
        last = words.groupBy(*s[:-1]).agg(F.max(s[-1]).alias("__no"))
        t = t.join(last, s[:-1], "left").withColumn("last", F.col(s[-1]) == F.col("__no")).drop("__no")
    g = pack(t, s, budget_of(cfg), cfg.context_span, block)
    schema = ", ".join(f"`{c}` {'int' if cfg.context_span > 0 and c == s[-1] else types[c]}" for c in (*s, "word_no"))
    arrow = {"int": "int32", "bigint": "int64", "smallint": "int16", "tinyint": "int8"}[types["word_no"]]
    out = g.mapInArrow(_renderer(cfg, s, arrow, block), schema + ", source string, target string")
    if as_arrays:
        out = out.withColumn("source", F.split("source", " ")).withColumn("target", F.split("target", " "))
    return out


def as_text(pairs: DataFrame) -> DataFrame:
    """Render source / target arrays as blank-separated lines (text passes through)."""
    out = pairs
    for c in ("source", "target"):
        if c in out.columns and out.schema[c].dataType.typeName() == "array":
            out = out.withColumn(c, F.array_join(c, " "))
    return out
