"""Global row numbers without funnelling all rows through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.session import ensure_checkpoint_dir


def global_row_number(df: DataFrame, order, out: str = "rn") -> DataFrame:
    """1-based row number in a total order, computed in parallel.

    Range-partitioned sort; every row learns its partition and its place in
    it from ``monotonically_increasing_id`` (partition id in the upper bits),
    the partition sizes (one row per partition) get a running sum, and a
    broadcast join of that small table adds the offset.  The sorted table is
    checkpointed to the cluster's checkpoint folder, so both passes see the
    same partitioning and a lost executor does not rerun the sort.
    ``order`` must be a total order (break ties explicitly).
    """
    ensure_checkpoint_dir(df.sparkSession)
    srt = df.orderBy(*order).withColumn("__mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    pid = F.shiftright(F.col("__mid"), 33)
    local = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = srt.groupBy(pid.alias("__pid")).agg(F.count("*").alias("__n"))
    offs = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(
        Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per partition of the sort: a size bounded by the partition count
    j = srt.join(F.broadcast(offs.select("__pid", "__off")), pid == F.col("__pid"), "inner")
    return j.withColumn(out, (F.col("__off") + local + 1).cast("bigint")).drop("__mid", "__pid", "__off")
