"""Benchmark decontamination over a positional inverted index.

``build_index`` tokenises the corpus once and stores, per segment of about a
million words, one row per distinct word with the delta-coded positions of the
word in the segment, and one row with the segment's documents.  A document is
never cut, so phrases are found inside one segment and the index needs no
shuffle.  ``search`` takes the windows of the benchmark items (in blocks of a
bounded number of words), counts how often each of their words occurs in the
whole corpus, and intersects in every segment the offset-adjusted position
lists of a window from its rarest word on, so that most windows end after one
or two short lists.  ``near`` reports the places where all words of a window
stand close to its rarest word, in any order.

Null and empty texts have no words and keep their row; a repeated row is a
document of its own; null ids are carried along; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import binaries, blobs, saved, word_bytes

WINDOW = 10
SEGMENT_WORDS = 1_000_000
BLOCK_WORDS = 1_000_000  # words of benchmark items that one search pass carries to all tasks

INDEX = "seg bigint, term binary, n bigint, postings binary, doc_ids array<string>"
MATCHES = ("seg bigint, doc int, doc_id string, n_words bigint, n_hit bigint, "
           "spans array<struct<start:bigint,end:bigint>>, items array<string>")


def _segment_rows(seg: int, ids: list, lists: list[list[bytes]]) -> pa.RecordBatch:
    """Index rows of one segment: its documents (term null), then a row per word."""
    code: dict[bytes, int] = {}
    ends = np.cumsum([0] + [len(x) for x in lists])
    flat = np.fromiter((code.setdefault(w, len(code)) for x in lists for w in x), dtype=np.int64, count=int(ends[-1]))
    order = np.argsort(flat, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(code)))]).astype(np.int64)
    gaps = np.diff(order, prepend=0)
    gaps[cuts[:-1]] = order[cuts[:-1]]  # the first position of each word is absolute
    n = len(code)
    postings = blobs(gaps.astype("<u4"), cuts).to_pylist()
    return pa.RecordBatch.from_arrays([
        pa.array([seg] * (n + 1), pa.int64()),
        pa.array([None, *code], pa.binary()),
        pa.array([len(ids), *np.diff(cuts).tolist()], pa.int64()),
        pa.array([ends.astype("<i8").tobytes(), *postings], pa.binary()),
        pa.array([ids] + [None] * n, pa.list_(pa.string()))], ["seg", "term", "n", "postings", "doc_ids"])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The stored index of ``docs``: see the module's head for its rows."""
    def index(batches):
        part, k, ids, lists, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), binaries(batch.column(1))):
                words = word_bytes(value) if value else []
                ids.append(doc)
                lists.append(words)
                size += len(words)
                if size >= segment_words:
                    yield _segment_rows((part << 32) | k, ids, lists)
                    k, ids, lists, size = k + 1, [], [], 0
        if ids:
            yield _segment_rows((part << 32) | k, ids, lists)

    rows = docs.select(F.col(key).cast("string"), F.col(text).cast("string")).mapInArrow(index, INDEX)
    return saved(rows, "postings")


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` words; the whole list if it is shorter, nothing if it is empty."""
    if not words:
        return []
    return [tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


def item_words(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words) of every item that has words."""
    def split(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([word_bytes(x) if x else [] for x in binaries(batch.column(1))], pa.list_(pa.binary()))],
                ["item", "words"])

    rows = items.select(F.col(key).cast("string").alias("item"), F.col(text).cast("string"))
    return rows.mapInArrow(split, "item string, words array<binary>").where(F.size("words") > 0)


def _blocks(items: DataFrame, block_words: int) -> list[dict]:
    """Windows of the items by block: {window: [items]}; a block has a bounded number of words."""
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-2 * total // block_words) if total > block_words else 1
    number = F.pmod(F.xxhash64("item", "words"), F.lit(n))
    for b in range(n):
        found: dict[tuple, set] = defaultdict(set)
        size = 0
        for row in items.where(number == b).toLocalIterator():
            words = [bytes(w) for w in row["words"]]
            size += len(words)
            for w in windows_of(words):
                found[w].add(row["item"])
            if size > block_words:  # a very long item fills a block
                yield {w: sorted(x, key=str) for w, x in found.items()}
                found, size = defaultdict(set), 0
        if found:
            yield {w: sorted(x, key=str) for w, x in found.items()}


def _frequencies(index: DataFrame, windows: dict) -> tuple[DataFrame, dict[bytes, int]]:
    """Index rows of the block's words, and each word's count in the corpus (as many as the block has words)."""
    terms = sorted({t for w in windows for t in w})
    listed = index.sparkSession.createDataFrame([(bytearray(t),) for t in terms], "term binary")
    mine = index.where(F.col("term").isNotNull()).join(F.broadcast(listed), "term", "left_semi")
    counts = mine.groupBy("term").agg(F.sum("n").alias("n")).collect()
    return mine, {bytes(r["term"]): r["n"] for r in counts}


def _plans(windows: dict, counts: dict[bytes, int]) -> list[tuple]:
    """Per window whose words all occur: (words with offsets from the rarest on, its length, items)."""
    plans = []
    for w, items in windows.items():
        if all(t in counts for t in w):
            plans.append((sorted(((t, i) for i, t in enumerate(w)), key=lambda x: (counts[x[0]], x[0], x[1])), len(w), items))
    return plans


def _postings(tab: pa.Table):
    """(document ids, document boundaries, word -> positions) of a segment's rows."""
    ids, ends, lists = [], np.zeros(1, np.int64), {}
    for term, blob, docs in zip(tab["term"].to_pylist(), tab["postings"].to_pylist(), tab["doc_ids"].to_pylist()):
        if term is None:
            ids, ends = docs, np.frombuffer(blob, "<i8")
        else:
            lists[term] = blob
    seen: dict[bytes, np.ndarray] = {}

    def positions(term: bytes):
        if term not in seen:
            blob = lists.get(term)
            seen[term] = None if blob is None else np.cumsum(np.frombuffer(blob, "<u4").astype(np.int64))
        return seen[term]
    return ids, ends, positions


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values of sorted ``a`` that are in sorted ``b``."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return a[b[at] == a]


def _exact(plan, ends, positions) -> np.ndarray:
    """Starts of a window in the segment: offset-adjusted lists met from the rarest word on."""
    steps, length, _ = plan
    starts = None
    for term, offset in steps:
        own = positions(term)
        if own is None:
            return np.zeros(0, np.int64)
        starts = own - offset if starts is None else _meet(starts, own - offset)
        if not len(starts):
            return starts
    starts = starts[starts >= 0]
    return starts[np.searchsorted(ends, starts, "right") == np.searchsorted(ends, starts + length - 1, "right")]


def _by_segment(index: DataFrame, windows: dict, func, schema: str) -> DataFrame:
    mine, counts = _frequencies(index, windows)
    plans = index.sparkSession.sparkContext.broadcast(_plans(windows, counts))  # bounded by the block
    rows = mine.select("seg", "term", "n", "postings", "doc_ids").unionByName(index.where(F.col("term").isNull()))
    return rows.groupBy("seg").applyInArrow(lambda tab: func(tab, plans.value), schema)


def _search(tab: pa.Table, plans: list) -> pa.Table:
    ids, ends, positions = _postings(tab)
    cover, items = np.zeros(int(ends[-1]) + 1, np.int32), defaultdict(set)
    for plan in plans:
        starts = _exact(plan, ends, positions)
        if len(starts):
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + plan[1], -1)
            for doc in np.unique(np.searchsorted(ends, starts, "right") - 1).tolist():
                items[doc].update(plan[2])
    hit = np.cumsum(cover[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    spans = []
    for doc in range(len(ids)):
        a, b = int(ends[doc]), int(ends[doc + 1])
        edges = np.flatnonzero(np.diff(hit[a:b].astype(np.int8), prepend=0, append=0)) if doc in items else []
        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])])
    return pa.table([
        pa.array([tab["seg"][0].as_py()] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()),
        pa.array(ids, pa.string()), pa.array(np.diff(ends).tolist(), pa.int64()),
        pa.array((total[ends[1:]] - total[ends[:-1]]).tolist() if len(ids) else [], pa.int64()),
        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        pa.array([sorted(items.get(d, ()), key=str) for d in range(len(ids))], pa.list_(pa.string()))],
        ["seg", "doc", "doc_id", "n_words", "n_hit", "spans", "items"])


def search(index: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document of the index: its words, the words inside any occurrence of a window of
    ``items`` (see ``item_words``), those occurrences' merged spans and the items hit."""
    found = [_by_segment(index, w, _search, MATCHES) for w in _blocks(items, block_words)]
    if not found:
        found = [_by_segment(index, {}, _search, MATCHES)]
    if len(found) == 1:
        return found[0]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    merged = rows.groupBy("seg", "doc", "doc_id", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    united = F.expr("""aggregate(all, cast(array() as array<struct<start:bigint,end:bigint>>), (a, s) ->
        CASE WHEN size(a) > 0 AND element_at(a, -1).end >= s.start
             THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end))))
             ELSE concat(a, array(s)) END)""")
    merged = merged.withColumn("spans", united)
    hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return merged.select("seg", "doc", "doc_id", "n_words", hit.alias("n_hit"), "spans", "items")


def near(index: DataFrame, items: DataFrame, slop: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item, position): places of a window's rarest word (ties: the smaller word) that have
    every other word of the window at most ``slop`` words away in the same document, in any order."""
    def look(tab: pa.Table, plans: list) -> pa.Table:
        ids, ends, positions = _postings(tab)
        out = set()
        for steps, _, owners in plans:
            at = positions(steps[0][0])
            for term, _ in steps[1:]:
                other = positions(term)
                if at is None or other is None or not len(at):
                    at = None
                    break
                doc = np.searchsorted(ends, at, "right") - 1
                lo, hi = np.maximum(at - slop, ends[doc]), np.minimum(at + slop, ends[doc + 1] - 1)
                at = at[np.searchsorted(other, lo) < np.searchsorted(other, hi, "right")]
            for p in [] if at is None else at.tolist():
                doc = int(np.searchsorted(ends, p, "right")) - 1
                out.update((ids[doc], item, p - int(ends[doc])) for item in owners)
        rows = sorted(out, key=str)
        return pa.table([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                         pa.array([r[2] for r in rows], pa.int64())], ["doc_id", "item", "position"])

    schema = "doc_id string, item string, position bigint"
    out = index.sparkSession.createDataFrame([], schema)
    for windows in _blocks(items, block_words):
        out = out.unionByName(_by_segment(index, windows, look, schema))
    return out.distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans."""
    rows = search(build_index(docs), item_words(benchmark))
    kind = docs.schema["doc_id"].dataType
    return rows.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "items", "spans")


def digest(items: list[str]) -> str:
    """The contract's digest of item ids, for tests."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
