"""Alignment against plain Python, with repeated, missing and null keys; sentences of the truth move once for all models."""

import pytest
from pyspark.sql import functions as F

from lexspark.operators import align

TRUTH = [("dev", 1, 0, 0, "a", "a", "N"), ("dev", 1, 0, 1, "b", "b", "V"), ("dev", 1, 0, 1, "b", "b", "V"), ("dev", 2, None, 0, "c", "c", "N"), ("test", 1, 0, 0, "d", "d", "N")]
SCHEMA = "part string, doc_id bigint, sent_no int, word_no int, word string, lemma string, tag string"


def _once(df):
    """No row is made per model below a shuffle."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "explode(__models" not in plan and "__models" in plan


def test_sentences_move_once_for_all_models(spark):
    lines = [(m, "dev", 1, 0, x) for m, x in ((1, "<w> a + N <s> b + V <s> z </w>"), (1, "<w> b + N </w>"), (2, "<w> q </w>"))] + [(3, "test", 9, 9, "<w> x </w>"), (1, "dev", 2, None, "<w> c + N </w>")]
    truth, hyps = spark.createDataFrame(TRUTH, SCHEMA), spark.createDataFrame(lines, "model_id int, part string, doc_id bigint, sent_no int, line string")
    got = align.align_sentences(truth, hyps)
    _once(got)
    found = {1: [("a", "N"), ("b", "V"), ("z", None)], 2: [("q", None), (None, None), (None, None)], 3: [(None, None)] * 3}
    want = [(m, "dev", 1, 0, w, x, *y) for m in found for (w, x), y in zip(((0, "a"), (1, "b"), (1, "b")), found[m])]
    want += [(m, *r[:5], None, None) for m in found for r in TRUTH[3:]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_match_rows_of_all_models(spark):
    pred = [(1, *TRUTH[0][:4], "a", "ax", "N"), (1, *TRUTH[1][:4], "b", "b", None), (1, *TRUTH[1][:4], "b", "c", "V"), (2, *TRUTH[0][:4], "a", None, "zz"), (3, "test", 7, 0, 0, "x", "x", "x"), (2, *TRUTH[3][:4], "c", "c", "N")]
    truth, p = spark.createDataFrame(TRUTH, SCHEMA), spark.createDataFrame(pred, f"model_id int, {SCHEMA}")
    got = align.match_table(p, truth.withColumn("eos", F.col("word") == "b"))
    want = []
    for t in TRUTH:
        for m in (1, 2, 3):
            mine = [r[5:] for r in pred if r[0] == m and r[1:5] == t[:4] and None not in t[:4]] or [(None, None, None)]
            want += [(m, *t[:4], *x, *t[4:], t[4] == "b") for x in mine]
    assert got.columns == ["model_id", "part", "doc_id", "sent_no", "word_no", *[f"{c}_prediction" for c in ("word", "lemma", "tag")], *[f"{c}_truth" for c in ("word", "lemma", "tag")], "eos"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("by", [(), ("part", "doc_id", "sent_no")])
def test_dealt_predictions_are_the_same(spark, sf_dir, by):
    from lexspark.sources import fixtures
    a, b = fixtures.predictions(spark, sf_dir), fixtures.predictions(spark, sf_dir, by=by)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
