"""The registered queries opN_<name>: thin digests of the operators' real outputs, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import table
from lexspark.llm.lines import ORACLE as LINES


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspark.llm.decontaminate import contamination
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspark.llm.warc import round_trip
    return round_trip(table(spark, sf_dir, "pages")).drop("intact")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspark.llm.embeddings import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspark.llm.minhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspark.llm.bpe import round_trip
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspark.llm.tokens import round_trip
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspark.llm.toxicity import score
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspark.llm.quality import KEEP, fit, score
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score(docs, fit(docs)).select("doc_id", "quality_score")
    return rows.withColumn("kept", rows["quality_score"] >= KEEP)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspark.llm.lines import dedup
    rows = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspark.llm.suffixes import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspark.llm.runs import periodic_runs, planted
    rows = periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = rows.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("b"), "collapsed",
                       F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"))
    return rows.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
                       F.expr("(1000 * b.length) div (-b.period)").alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspark.llm.lexical import build_index, search
    return search(spark, build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 20)


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspark.llm.bitslice import build_index, search
    vectors = table(spark, sf_dir, "embeddings")
    return search(build_index(vectors), vectors.where("vec_id % 50 = 0"), 5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc": op2_warc,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_bpe": op6_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_ids": op10_token_ids,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_lexical_search": op12_lexical_search,
    "op13_topk_search": op13_topk_search,
}

ORACLE: dict[str, str] = {
    "op12_lexical_search": r"""
        WITH dw AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL),
        bw AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
        s AS (SELECT count(*) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM dw WHERE len(ws) > 0),
        p AS (SELECT d, doc_id, len(ws) AS n, term, count(*) AS tf FROM (SELECT d, doc_id, ws, unnest(ws) AS term FROM dw) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * s.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, s.n),
        t AS (SELECT i, item_id, term, count(*) AS times FROM bw GROUP BY ALL),
        r AS (SELECT t.i, t.item_id, p.d, p.doc_id, CAST(sum(t.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * s.n) // s.l)))) AS BIGINT) AS score
              FROM t JOIN w USING (term) JOIN p USING (term), s GROUP BY ALL),
        o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20""",
    "op13_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_line_dedup": LINES,
    "op2_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
               CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
}
