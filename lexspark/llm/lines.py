"""Line dedup over pairs of neighbouring lines, in DataFrame functions only.

A text is split into lines.  A run of two lines or more that stands at an
earlier place of the corpus too (same document included) is removed whole,
wherever it begins and ends: every two neighbouring lines are a candidate, and
the pairs of a longer run overlap.  The first place of a pair (smallest doc_id,
then smallest digest of the text, then smallest line number) stays, and so does
a pair that overlaps its own first place.  Equality is decided on the bytes, the
pair's hash only brings candidates together.  What is left of a text keeps its
order; every removed line still stands at an earlier place.

Null texts stay null and empty texts empty.  A row is known by its doc_id and
its text: rows that share an id (null is one like any other and comes first) but
not the text are different documents, rows that share both are one, whose lines
count once.  Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import same_key, saved, text_digest

# Each transform(array(x), v -> ...)[0] names an intermediate value, so that it is computed once a text.
_PAIRS = """transform(array(transform(split({text}, '\\n', -1), l -> xxhash64(l))), hs ->
    transform(sequence(0, size(hs) - 2), i -> named_struct('no', i, 'h', xxhash64(hs[i], hs[i + 1]))))[0]"""
_LINES = """transform(array(split({text}, '\\n', -1)), ls -> transform(pairs, p ->
    named_struct('no', p.no, 'h', p.h, 'is_first', p.is_first, 'lines', concat(ls[p.no], '\\n', ls[p.no + 1]))))[0]"""
_LEFT = """transform(array(split({text}, '\\n', -1)), ls -> transform(array(
    array_except(sequence(0, size(ls) - 1), array_union(__gone, transform(__gone, i -> i + 1)))), left ->
    named_struct('text', array_join(transform(left, i -> ls[i]), '\\n'), 'n', size(ls) - size(left)))[0])[0]"""


def pairs(text: str) -> Column:
    """array<struct<no, h>> of the column named ``text``, which has two lines or more: first line's number (from 0) and hash of each pair."""
    return F.expr(_PAIRS.format(text=f"`{text}`"))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, digest, no): pairs of the lines ``no`` and ``no + 1`` that stand at an earlier place too."""
    texts = docs.where(F.instr(text, "\n") > 0).select(F.col(key).alias("doc"), text_digest(text).alias("digest"), F.col(text).alias("text"))
    rows = saved(texts.select("doc", "digest", F.inline(pairs("text"))), "line-pairs")
    place = F.struct("doc", "digest", "no")
    groups = rows.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <=> last = false")
    groups = saved(groups.drop("last"), "repeated-pairs")  # two plain shuffles meet below: a frequent pair splits
    overlaps = same_key(place, F.struct("first.doc", "first.digest", (F.col("first.no") + 1).alias("no")))
    shared = rows.join(groups, "h").where(~overlaps).select("doc", "digest", F.struct("no", "h", same_key(place, F.col("first")).alias("is_first")).alias("pair"))
    wanted = saved(shared.groupBy("doc", "digest").agg(F.collect_set("pair").alias("pairs")), "shared-pairs")
    wanted = wanted.withColumnsRenamed({"doc": "__doc", "digest": "__digest"})
    found = texts.join(wanted, same_key(texts["doc"], wanted["__doc"]) & (texts["digest"] == wanted["__digest"]))
    found = saved(found.select("doc", "digest", F.inline(F.expr(_LINES.format(text="text")))), "shared-lines")
    firsts = saved(found.where("is_first").select("h", F.col("lines").alias("first_lines")).distinct(), "first-lines")
    # A second text under one hash keeps all its places: nothing is removed on a hash alone.
    return found.where("NOT is_first").join(firsts, "h").where("lines = first_lines").select("doc", "digest", "no")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the shortened ``text`` and two more columns: n_lines and n_removed (lines)."""
    gone = repeated(docs, key, text).groupBy("doc", "digest").agg(F.collect_set("no").alias("__gone"))
    gone = gone.withColumnsRenamed({"doc": "__doc", "digest": "__of"})
    rows = docs.withColumn("__digest", text_digest(text))
    rows = rows.join(gone, same_key(rows[key], gone["__doc"]) & (rows["__digest"] == gone["__of"]), "left").drop("__doc", "__of", "__digest")
    # One list of lines a text: the kept text and the number of lines removed come from the same value.
    rows = rows.withColumn("__kept", F.when(F.col("__gone").isNotNull(), F.expr(_LEFT.format(text=f"`{text}`"))))
    rows = rows.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1).cast("bigint"))
    rows = rows.withColumn("n_removed", F.coalesce(F.col("__kept.n"), F.lit(0)).cast("bigint"))
    return rows.withColumn(text, F.when(F.col("__kept").isNull(), F.col(text)).otherwise(F.col("__kept.text"))).drop("__gone", "__kept")


# The same rule: a pair of neighbouring lines goes where it stands at an earlier place, unless it overlaps that place.
ORACLE = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, no, ls[no] || chr(10) || ls[no + 1] AS pair FROM (SELECT doc_id, ls, unnest(range(1, len(ls))) AS no FROM l)),
f AS (SELECT doc_id, no, first_value(doc_id) OVER w AS first_doc, first_value(no) OVER w AS first_no FROM p WINDOW w AS (PARTITION BY pair ORDER BY doc_id, no)),
g AS (SELECT DISTINCT doc_id, unnest([no, no + 1]) AS no FROM f WHERE NOT (doc_id = first_doc AND no - first_no IN (0, 1))),
n AS (SELECT doc_id, len(ls) AS n_lines, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS no FROM l),
k AS (SELECT n.doc_id, any_value(n_lines) AS n_lines, count(g.no) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY n.no) FILTER (WHERE g.no IS NULL), '') AS kept
      FROM n LEFT JOIN g ON n.doc_id = g.doc_id AND n.no = g.no GROUP BY n.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(kept) END AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
