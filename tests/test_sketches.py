"""Sketches of type sets: errors within their bound, and merging deliveries."""

from pyspark.sql import functions as F

from lexspark.operators import sketches


def corpus(spark, n_train, n_dev, shared):
    row = lambda part, lo, hi: spark.range(lo, hi).select(F.lit(part).alias("part"), (F.col("id") % 3).alias("file"), F.concat(F.lit("w"), "id").alias("word"),
                                                      F.concat(F.lit("l"), F.col("id") % 7).alias("lemma"), F.lit(None).cast("string").alias("tag"))
    return row("training", 0, n_train).unionByName(row("dev", n_train - shared, n_train - shared + n_dev))


def test_estimates_within_their_bound(spark):
    t = corpus(spark, 200_000, 80_000, 30_000)
    e = {(r.part, r["column"]): r for r in sketches.estimates(sketches.type_sketches(t, "file")).collect()}
    assert abs(e["training", "word"].n_types - 200_000) <= 5 * e["training", "word"].types_sd < 10_000
    dev = e["dev", "word"]
    assert abs(dev.n_unseen - 50_000) <= 5 * dev.unseen_sd < 12_000 and e["training", "word"].n_unseen is None
    assert (e["dev", "lemma"].n_types, e["dev", "lemma"].n_unseen, e["dev", "lemma"].unseen_sd) == (7, 0, 0)
    assert ("dev", "tag") not in e  # missing values are no types


def test_merging_deliveries_changes_nothing(spark):
    t = corpus(spark, 30_000, 9_000, 2_000)
    whole = {(r.part, r["column"]): (r.n_types, r.n_unseen) for r in sketches.estimates(sketches.type_sketches(t, "file")).collect()}
    old, new = (sketches.type_sketches(t.where(c), "file") for c in ("file < 2 AND hash(word) % 2 = 0", "NOT (file < 2 AND hash(word) % 2 = 0)"))
    table = sketches.merged(old, new)
    assert table.count() == sketches.type_sketches(t, "file").count()
    both = {(r.part, r["column"]): (r.n_types, r.n_unseen) for r in sketches.estimates(table).collect()}
    assert both.keys() == whole.keys()
    assert all(abs(both[k][0] - whole[k][0]) <= 0.02 * whole[k][0] for k in whole)
    assert sketches.estimates(sketches.type_sketches(t.limit(0), "file")).count() == 0
