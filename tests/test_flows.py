"""End-to-end flows F1 and F2 on the smallest data set."""

import pytest
from pyspark.sql import functions as F

from lexspark.config import TransformConfig
from lexspark.operators import align, clean, context, segment, sentences
from lexspark.plans import corpus, flows
from lexspark.sources import fixtures


def test_corpus_to_pairs_all_partitions(spark, sf_dir):
    toks = fixtures.tokens(spark, sf_dir)
    pairs = flows.corpus_to_pairs(toks, TransformConfig(context_size=5))
    parts = {r.part for r in pairs.select("part").distinct().collect()}
    assert parts == {"training", "dev", "test"}
    complete, rejected = clean.split_rejects(corpus.clean_tokens(spark, sf_dir))
    assert rejected.count() > 0 and pairs.count() == complete.count()
    text = context.as_text(pairs)
    assert text.where("target IS NULL OR target LIKE '<w> +%' OR target LIKE '%+ </w>'").count() == 0


def test_misaligned_hypotheses_fail(spark):
    keys = "part string, doc_id bigint, sent_no int, word_no int"
    truth = spark.createDataFrame([("dev", 1, 0, k, f"w{k}") for k in range(4)], keys + ", word string")
    hyps = spark.createDataFrame([("dev", 1, 0, 0, 1, "a + b"), ("dev", 9, 0, 0, 1, "c + d")], keys + ", model_id int, line string")
    row = align.align_check(truth, hyps).first()
    assert (row.n_matched, row.n_missing, row.n_extra) == (1, 3, 1)
    with pytest.raises(ValueError, match="do not align"):
        align.require_aligned(truth, hyps)


def test_blank_runs_go_on_across_files(spark):
    rows = [(1, 0, "first"), (1, 1, "a"), (1, 2, " "), (2, 0, ""), (2, 1, "\t"), (2, 2, "b"), (3, 0, " "), (3, 1, "c")]
    got = segment.collapse_blanks(spark.createDataFrame(rows, "doc_id bigint, line_no int, line string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "a"), (1, 2, ""), (2, 2, "b"), (3, 0, ""), (3, 1, "c")]


def test_hypotheses_to_scores_matches_score_row(spark, sf_dir):
    ct = corpus.clean_tokens(spark, sf_dir)
    hyps = fixtures.hypotheses(spark, sf_dir)
    got = flows.hypotheses_to_scores(hyps, ct.where(F.col("part").isin("dev", "test")),
                                     ct.where(F.col("part") == "training"), corpus.SCRIPT)
    assert got.count() == 6  # 3 models x dev, test
    row = got.where("model_id = 1 AND part = 'dev'").first()
    assert 0.0 <= row.all_lemma <= 1.0 and row.all_joint <= row.all_lemma


def test_empty_sentence_pairs(spark, golden):
    cfg = TransformConfig(mode="sentence_to_sentence")
    keys = spark.createDataFrame([("dev", 1, 0), ("dev", 1, 1), ("dev", 1, 2)], "part string, doc_id bigint, sent_no int")
    e = sentences.empty_sentence_pairs(keys, golden, cfg)
    rows = context.as_text(e).collect()
    assert [(r.sent_no, r.source) for r in rows] == [(2, "<w> </w>")]
