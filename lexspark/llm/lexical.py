"""Ranked lexical search by MaxScore with bounds of term pairs.

The index is cut into segments of neighbouring documents: one row per segment
and term with the documents that hold it and how often, and one row per segment
with its documents' ids and lengths.  A search over a stated set of items goes
as follows.

1. The terms' weights come from the document frequencies, summed over segments.
2. Each segment's lists of the wanted terms become impacts with their maximum.
   Of every item the rarer terms that the segment holds are paired in the order
   of their weights, and the pair's intersection list is stored with the joint
   impacts; its bound is the largest sum that any document of the segment has
   from the two terms, which is at most the sum of their maxima and, for
   terms that seldom meet, about half of it.
3. The sums over an item's intersection lists bound scores from below: the k-th
   best of the corpus is a threshold that the item's k-th best score reaches.
4. In each segment, the pairs and single terms are ordered by bound.  Those whose
   bounds together stay below the threshold cannot bring a document in on their
   own, so only documents of the others are scored; they are dropped as soon as
   score and bounds left stay below the threshold, which rises on the way.  A
   segment whose bounds all together stay below it is skipped.
5. The k best of every segment meet in one ranking.

Bounds only skip documents that score strictly below the threshold; ties
at it are all scored.  A segment holds at most ``DOCS`` documents and about
``WORDS`` words; items are dealt to blocks of some ``ITEMS``, and a segment and a
block meet in a group of their own, so that no word, item or source makes a
task larger than a segment's lists.

Terms are runs of ASCII letters and digits and of all beyond ASCII; only A-Z are
lower-cased.  Null and empty texts have no terms: such documents are
not counted and never found, such items find nothing.  Every row is a document
or an item of its own, repeated ids included; a document without an id comes
after others of its score.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import binaries, blobs, saved, shared_path, word_bytes

DOCS, WORDS = 16_384, 2_000_000
ITEMS = 256
RARE = 8  # a term is paired where at most one document in so many holds it
ROW = [("segment", pa.int64()), ("term", pa.binary()), ("df", pa.int32()), ("docs", pa.binary()), ("tf", pa.binary()),
       ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("n_docs", pa.int64()), ("n_words", pa.int64()), ("kind", pa.string())]
INDEX = ("segment bigint, term binary, df int, docs binary, tf binary, ids array<bigint>, lengths binary, n_docs bigint, "
         "n_words bigint, kind string")
LIST = [("segment", pa.int64()), ("block", pa.int32()), ("kind", pa.string()), ("term", pa.binary()), ("other", pa.binary()),
        ("times", pa.int64()), ("other_times", pa.int64()), ("weight", pa.int64()), ("item_no", pa.int64()), ("docs", pa.binary()),
        ("impacts", pa.binary()), ("top", pa.int64())]
LISTS = ("segment bigint, block int, kind string, term binary, other binary, times bigint, other_times bigint, weight bigint, "
         "item_no bigint, docs binary, impacts binary, top bigint")


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def _segment(number: int, keys: list, texts: list[np.ndarray], codes: dict) -> list[pa.RecordBatch]:
    """The segment's own row and a row per term, by term."""
    lengths = np.array([len(t) for t in texts], np.int64)
    terms = sorted(codes)
    place = np.empty(len(terms), np.int64)
    place[[codes[t] for t in terms]] = np.arange(len(terms))
    cells = (place[np.concatenate(texts)] << 16) | np.repeat(np.arange(len(texts)), lengths)
    cells, tf = np.unique(cells, return_counts=True)
    ends = np.searchsorted(cells >> 16, np.arange(len(terms) + 1))
    n = len(terms)
    many = lambda k, kind: pa.nulls(k, kind)
    posts = [pa.array(np.full(n, number)), pa.array(terms, pa.binary()), pa.array(np.diff(ends), pa.int32()),
             blobs((cells & 0xFFFF).astype("<u2"), ends), blobs(tf.astype("<u4"), ends),
             many(n, ROW[5][1]), many(n, pa.binary()), many(n, pa.int64()), many(n, pa.int64()), pa.array(["terms"] * n)]
    own = [pa.array([number]), *[many(1, t) for _, t in ROW[1:5]], pa.array([keys], ROW[5][1]),
           pa.array([lengths.astype("<i8").tobytes()]), pa.array([len(keys)]), pa.array([int(lengths.sum())]), pa.array(["segment"])]
    return [pa.RecordBatch.from_arrays(c, schema=pa.schema(ROW)) for c in (own, posts)]


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", max_docs: int = DOCS, max_words: int = WORDS) -> str:
    """The path of the index over all terms of all documents, in the shared folder."""

    def run(batches):
        number, keys, texts, size, codes = TaskContext.get().partitionId() << 32, [], [], 0, _Codes()
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), binaries(batch.column(1))):
                words = word_bytes(value) if value else []
                if not words:
                    continue
                keys.append(k)
                texts.append(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)))
                size += len(words)
                if len(keys) == max_docs or size >= max_words:
                    yield from _segment(number, keys, texts, codes)
                    number, keys, texts, size, codes = number + 1, [], [], 0, _Codes()
        if keys:
            yield from _segment(number, keys, texts, codes)

    path = shared_path(docs.sparkSession, "lexical-index")
    rows = docs.select(F.col(key).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, INDEX)
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return path


def _terms(items: DataFrame, key: str, text: str, per_block: int) -> tuple[DataFrame, DataFrame, int]:
    """Items (block, item_no, item_id, text) and their terms (block, item_no, term, times)."""
    blocks = max(1, -(-items.count() // per_block))
    rows = items.select(F.col(key).alias("item_id"), F.col(text).cast("string").alias("text")).repartition(blocks)
    rows = saved(rows.select(F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("item_no"), "item_id", "text"), "items")
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(small, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), 0)
    words = rows.select("block", "item_no", F.explode(F.transform(found, lambda t: t.cast("binary"))).alias("term"))
    return rows, saved(words.groupBy("block", "item_no", "term").agg(F.count("*").alias("times")), "item-terms"), blocks


def paired(terms: list[tuple], size: dict, n_docs: int, rare: int) -> list[tuple]:
    """Units of an item: pairs of its rarer terms, neighbours by weight, and single terms.  ``terms``: (weight, term, times)."""
    terms = sorted(terms, key=lambda t: (-t[0], t[1]))
    few = [t for t in terms if size[t[1]] * rare <= n_docs]
    chosen = {t[1] for t in few[:len(few) // 2 * 2]}
    return list(zip(few[0::2], few[1::2])) + [(t,) for t in terms if t[1] not in chosen]


def _by_item(rows: list[dict]) -> dict:
    """item_no -> [(weight, term, times)], and what else a use carries."""
    items: dict[int, list] = {}
    for r in rows:
        for use in r["uses"] or ():
            items.setdefault(use["item_no"], []).append((r["weight"], r["term"], use["times"], use.get("least")))
    return items


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    return np.sort(scores)[::-1][:k] if len(scores) <= k else np.sort(np.partition(scores, -k)[-k:])[::-1]


def _lists(rows: list[dict], lengths: np.ndarray, n: int, total: int, k: int, rare: int):
    """Impact lists of the segment's wanted terms, intersection lists of the items' pairs, and lower bounds of each item's scores."""
    m = 75 + 25 * lengths * n // total
    impact, docs = {}, {}
    for r in rows:
        at, tf = np.frombuffer(r["docs"], "<u2").astype(np.int64), np.frombuffer(r["tf"], "<u4").astype(np.int64)
        docs[r["term"]], impact[r["term"]] = at, 1_000_000_000 * tf // (1000 * tf + 12 * m[at])
        yield {"kind": "single", "term": r["term"], "weight": r["weight"], "docs": r["docs"],
               "impacts": impact[r["term"]].astype("<u4").tobytes(), "top": int(impact[r["term"]].max())}
    size, known = {t: len(d) for t, d in docs.items()}, {}
    for item_no, terms in _by_item(rows).items():
        least = []
        for unit in paired([t[:3] for t in terms], size, len(lengths), rare):
            if len(unit) == 1:
                continue
            (wa, a, na), (wb, b, nb) = unit
            if (a, na, b, nb) not in known:
                both, i, j = np.intersect1d(docs[a], docs[b], assume_unique=True, return_indices=True)
                joint = na * wa * impact[a][i] + nb * wb * impact[b][j]
                top = max(na * wa * int(impact[a].max()), nb * wb * int(impact[b].max()), int(joint.max(initial=0)))
                known[a, na, b, nb] = both, joint
                yield {"kind": "pair", "term": a, "other": b, "times": na, "other_times": nb, "docs": both.astype("<u2").tobytes(),
                       "impacts": joint.astype("<i8").tobytes(), "top": top}
            if len(known[a, na, b, nb][0]):
                least.append(known[a, na, b, nb])
        if least:
            sums = np.zeros(len(lengths), np.int64)
            for both, joint in least:
                sums[both] += joint
            yield {"kind": "least", "item_no": item_no, "impacts": _best(sums[sums > 0], k).astype("<i8").tobytes()}


def _add(score: np.ndarray, found: np.ndarray, docs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Adds the values of a list to the scores of those of ``found`` that it holds; which these are."""
    if not len(docs) or not len(found):
        return np.zeros(len(found), bool)
    at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
    hit = docs[at] == found
    score[found[hit]] += values[at[hit]]
    return hit


def search_segment(single: dict, pair: dict, terms: list[tuple], n_docs: int, least: int, k: int, rare: int = RARE) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, documents looked at) of one item: all that may be among the ``k`` best and score ``least`` or more.

    ``single``: term -> (docs, impacts, top); ``pair``: (term, times, other, times) -> (docs, joint impacts, top).
    """
    size = {t: len(single[t][0]) for _, t, _ in terms}
    units = []
    for unit in paired(terms, size, n_docs, rare):
        alone = max(w * times * single[t][2] for w, t, times in unit)
        held = pair.get((unit[0][1], unit[0][2], unit[1][1], unit[1][2])) if len(unit) == 2 else None
        units.append((held[2] if held else alone, alone, held, unit))
    units.sort(key=lambda u: u[0])
    bound = np.cumsum([u[0] for u in units])
    score, nothing = np.zeros(n_docs, np.int64), np.zeros(0, np.int64)
    if not units or bound[-1] < least:
        return nothing, nothing, 0
    first = int(np.searchsorted(bound, least))  # the units before it stay below the threshold together
    for _, _, _, unit in units[first:]:
        for w, t, times in unit:
            score[single[t][0]] += w * times * single[t][1]
    found = np.flatnonzero(score)
    seen = len(found)
    for u in range(first - 1, -1, -1):
        if len(found) > k:
            least = max(least, int(_best(score[found], k)[-1]))
        found = found[score[found] + bound[u] >= least]
        _, alone, held, unit = units[u]
        open_ = found
        if held:  # the intersection list settles its documents; the others have one of the two terms at most
            hit = _add(score, found, held[0], held[1])
            open_ = found[~hit]
            alive = score[open_] + alone + (bound[u - 1] if u else 0) >= least
            found, open_ = np.sort(np.append(found[hit], open_[alive])), open_[alive]
        for w, t, times in unit:
            _add(score, open_, single[t][0], w * times * single[t][1])
    found = found[(score[found] >= least) & (score[found] > 0)]
    if len(found) > k:
        found = found[score[found] >= _best(score[found], k)[-1]]
    return found, score[found], seen


def search(spark, index: str, items: DataFrame, k: int, key: str = "item_id", text: str = "text", per_block: int = ITEMS, rare: int = RARE) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every row of ``items``."""
    posts, segments = (spark.read.schema(INDEX).parquet(index).where(F.col("kind") == kind) for kind in ("terms", "segment"))
    named, terms, blocks = _terms(items, key, text, per_block)
    n, total = segments.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(1))).first()
    df = posts.join(terms.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n + 2)) / (2 * F.col("df") + 1))).cast("bigint")
    weighted = saved(terms.join(df.select("term", weight.alias("weight")), "term").where("weight > 0"), "weighted-terms")
    uses = weighted.groupBy("block", "term").agg(F.first("weight").alias("weight"), F.collect_list(F.struct("item_no", "times")).alias("uses"))
    each = segments.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def make(own: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        segment, block = (x.as_py() for x in own)
        rows = left.to_pylist()
        lengths = np.frombuffer(right["lengths"][0].as_py(), "<i8")
        out = [{"segment": segment, "block": block, **r} for r in _lists(rows, lengths, n, total, k, rare)] if rows else []
        return pa.Table.from_pylist(out, schema=pa.schema(LIST))

    wanted = posts.join(uses, "term").select("segment", "block", "term", "weight", "docs", "tf", "uses")
    lists = saved(wanted.groupBy("segment", "block").cogroup(each.select("segment", "block", "lengths").groupBy("segment", "block"))
                  .applyInArrow(make, LISTS), "impact-lists")

    best = Window.partitionBy("item_no").orderBy(F.desc("value"))
    values = F.udf(lambda b: np.frombuffer(b, "<i8").tolist(), "array<bigint>")  # at most k numbers an item and segment
    bounds = lists.where("kind = 'least'").select("item_no", F.explode(values("impacts")).alias("value"))
    bounds = bounds.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("item_no", F.col("value").alias("least"))
    asked = weighted.join(bounds, "item_no", "left").groupBy("block", "term").agg(
        F.collect_list(F.struct("item_no", "times", F.coalesce("least", F.lit(0)).alias("least"))).alias("uses"))

    def find(own: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, single, pair, out = left.to_pylist(), {}, {}, []
        for r in rows:
            docs = np.frombuffer(r["docs"], "<u2").astype(np.int64)
            if r["kind"] == "single":
                single[r["term"]] = docs, np.frombuffer(r["impacts"], "<u4").astype(np.int64), r["top"]
            else:
                pair[r["term"], r["times"], r["other"], r["other_times"]] = docs, np.frombuffer(r["impacts"], "<i8"), r["top"]
        ids = right["ids"][0].as_py()
        for item_no, terms in _by_item(rows).items():
            docs, scores, _ = search_segment(single, pair, [t[:3] for t in terms], len(ids), terms[0][3], k, rare)
            some = sorted(zip((-scores).tolist(), [ids[d] is None for d in docs], [ids[d] or 0 for d in docs]))[:k]
            out += [(item_no, None if null else i, -s) for s, null, i in some]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], ["item_no", "doc_id", "score"])

    columns = ["segment", "block", "kind", "term", "other", "times", "other_times", "weight", "docs", "impacts", "top"]
    singles = lists.where("kind = 'single'").join(asked, ["block", "term"]).select(*columns, "uses")
    both = singles.unionByName(lists.where("kind = 'pair'").select(columns), allowMissingColumns=True)
    found = both.groupBy("segment", "block").cogroup(each.select("segment", "block", "ids").groupBy("segment", "block")).applyInArrow(
        find, "item_no bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(named.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")
