"""The broadcast sieve of hashes: it lets every wanted row through and few others."""

from pyspark.sql import functions as F


def test_sieve(spark):
    from lexspark.llm.common import sifted
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h")).unionByName(spark.createDataFrame([(-1, None)], "id bigint, h bigint"))
    wanted = rows.where("id % 10 = 3").select("h")
    got = sifted(rows, "h", wanted, 2_000)
    assert got.columns == ["id", "h", "__maybe"] and got.count() == 20_001
    assert got.where("id % 10 = 3 AND NOT __maybe").count() == 0
    assert got.where("id % 10 <> 3 AND __maybe").count() < 4_500
    assert sifted(rows, "h", wanted.limit(0), 0).where("__maybe").count() == 0
    tiny = sifted(rows, "h", rows.select("h"), 20_000, most=15)  # more hashes than bits: nothing is lost
    assert tiny.where("id >= 0 AND NOT __maybe").count() == 0


def test_discarded_tables_are_gone(spark):
    import pytest
    from lexspark.llm.common import discarded, saved
    df = saved(spark.range(10), "short-lived")
    assert df.count() == 10
    discarded(df)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()
