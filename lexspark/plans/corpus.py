"""Shared inputs of the named queries, derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.patterns import LATIN_START
from lexspark.operators import align, clean, profile
from lexspark.sources import fixtures

# The derived corpus is Latin-script; the evaluation filter's script class follows it.
SCRIPT = LATIN_START


def clean_tokens(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """Cleaned (C1-C5) derived corpus, written once per input folder; a query that reads it ``once`` takes it unwritten if need be."""
    from lexspark.sources.store import at_hand, materialized
    cols = ["doc_id", "lang", "part", "sent_no", "word_no", "word", "lemma", "tag"]
    build = lambda: clean.clean_for_train(fixtures.tokens(spark, sf_dir)).select(*cols)
    t = at_hand(spark, "clean_tokens", sf_dir, build) if once else materialized(spark, "clean_tokens", sf_dir, build, partition_by=["part"])
    return t.select(*cols)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.with_eval_flag(clean_tokens(spark, sf_dir), SCRIPT)


def all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).where("is_eval")


def truth_with_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspark.operators.segment import eos_flags
    ct = clean_tokens(spark, sf_dir).where(F.col("part").isin("dev", "test"))
    return clean.drop_incomplete(eos_flags(ct))  # C9: rows without a label are no truth


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match table with all flags for the fixture predictions of three models (written once)."""
    from lexspark.sources.store import materialized
    return materialized(spark, "match_flags", sf_dir, lambda: _flags(spark, sf_dir), partition_by=["part"])


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ct = clean_tokens(spark, sf_dir)
    train = ct.where(F.col("part") == "training")
    truth_pre = ct.where(F.col("part").isin("dev", "test"))
    from lexspark.sources.store import materialized
    m = materialized(spark, "match_table", sf_dir, lambda: align.match_table(fixtures.predictions(spark, sf_dir), truth_with_eos(spark, sf_dir)))
    return align.match_flags(m, train, truth_pre, script=SCRIPT)


def training_pairs(spark: SparkSession, sf_dir: str, cfg=None) -> DataFrame:
    from lexspark.config import TransformConfig
    from lexspark.operators.context import build_examples
    ct = clean_tokens(spark, sf_dir)
    return build_examples(ct.where(F.col("part") == "training"), cfg or TransformConfig())


# Fixed values of the runs fixture: 8 experiments x 3 repeats, job ids from 1000.
RUN_INITIAL, RUN_EXPERIMENTS, RUN_REPEATS = 1000, 8, 3


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of repeated runs: experiment i uses model 1 + i % 3 on dev, repeat j adds 0.001 * j.

    (job_id, model_id, slice, metric, value) with job_id = 1000 + i + 8 * j.
    """
    from lexspark.operators.score import score_slices
    sc = score_slices(flags(spark, sf_dir).where(F.col("part") == "dev")) \
        .where(F.col("slice").isin("all", "unseen", "ambiguous"))
    grid = [(i, j) for i in range(RUN_EXPERIMENTS) for j in range(RUN_REPEATS)]
    ij = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in grid])).alias("ij")
    x = sc.select("model_id", "slice", "metric", "value", ij)
    x = x.where(F.col("model_id") == 1 + F.col("ij.i") % 3)
    return x.select((F.lit(RUN_INITIAL) + F.col("ij.i") + RUN_EXPERIMENTS * F.col("ij.j")).cast("int").alias("job_id"),
                    "model_id", "slice", "metric", (F.col("value") + 0.001 * F.col("ij.j")).alias("value"))


def run_configs(spark: SparkSession) -> DataFrame:
    """Experiment -> configuration name (the first 8 of the test grid)."""
    from lexspark.config import TEST_GRID
    rows = [(i, TEST_GRID[i].config_id("corpus")) for i in range(RUN_EXPERIMENTS)]
    return spark.createDataFrame(rows, "experiment int, config_id string")
