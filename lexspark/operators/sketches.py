"""Mergeable sketches of type sets (P2, P4 at scale): counts of types and of unseen types without the types.

A stored row holds, per part, column and shard (a file, a language, a day), a
HyperLogLog sketch for the number of types and a theta sketch of the type set.
Sketches of new files are merged into the table row by row; the old files are not
read again.  A sketch has a fixed size whatever its set holds.

Errors: one standard deviation of the count is 1.04 / sqrt(2^HLL) of it; of the
unseen types 1 / sqrt(2^THETA) of the types of both sets together.  Sets of fewer
than 2^THETA types are counted without error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HLL, THETA = 14, 14  # binary logarithms of the sketches' sizes: 16 KB and up to 128 KB
COLS = ("word", "lemma", "tag")


def type_sketches(tokens: DataFrame, shard: str) -> DataFrame:
    """(part, column, shard, hll, theta) of the types that are not null."""
    long = tokens.select("part", F.col(shard).cast("string").alias("shard"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in COLS]))).where("value IS NOT NULL")
    return long.groupBy("part", "column", "shard").agg(F.hll_sketch_agg("value", F.lit(HLL)).alias("hll"), F.theta_sketch_agg("value", F.lit(THETA)).alias("theta"))


def merged(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored table with the sketches of new files; shards that both have become one row."""
    return stored.unionByName(new).groupBy("part", "column", "shard").agg(
        F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", F.lit(THETA)).alias("theta"))


def estimates(stored: DataFrame, train: str = "training") -> DataFrame:
    """(part, column, n_types, n_unseen, types_sd, unseen_sd): estimates and their standard deviations.

    ``n_unseen``: types of a part that the training part lacks (null for the training part itself).
    """
    per = stored.groupBy("part", "column").agg(F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", F.lit(THETA)).alias("theta"))
    seen = per.where(F.col("part") == train).select("column", F.col("theta").alias("__seen"))  # a row per column
    both = per.join(F.broadcast(seen), "column", "left")
    other = F.col("part") != train
    unseen = F.when(F.col("__seen").isNull(), F.theta_sketch_estimate("theta")).otherwise(
        F.theta_sketch_estimate(F.theta_difference("theta", F.coalesce("__seen", "theta"))))
    united = F.theta_sketch_estimate(F.theta_union("theta", F.coalesce("__seen", "theta")))
    exact = united < F.lit(1 << THETA)
    return both.select("part", "column", F.hll_sketch_estimate("hll").alias("n_types"), F.when(other, unseen).alias("n_unseen"),
                       (F.lit(1.04 / 2 ** (HLL / 2)) * F.hll_sketch_estimate("hll")).alias("types_sd"),
                       F.when(other, F.when(exact, F.lit(0.0)).otherwise(united / 2 ** (THETA / 2))).alias("unseen_sd"))
