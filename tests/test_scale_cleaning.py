"""What cleaning costs for each letter, and the tasks it runs in."""

from pyspark.sql import functions as F

from claimloom.functions.normalise import foreign_pattern, normalise
from claimloom.session import spread


def test_spread_counts_filled_partitions(spark, tmp_path):
    """A file of one row group is one task, however many partitions its scan is cut into."""
    spark.range(200000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = spark.read.parquet(str(tmp_path / "t"))
        assert df.rdd.getNumPartitions() >= 4
        filled = spread(df).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert filled >= 4


def test_ascii_needs_no_list(spark):
    """The class of foreign characters turns ASCII down before its list of runs, and finds the same ones."""
    assert foreign_pattern().startswith(r"[\x{80}-\x{10FFFF}&&")
    df = spark.createDataFrame([("a b",), ("é",), ("ﬁ x",), ("é\x07ü",), ("a\x07b",)], "t string")
    assert [r.n for r in df.select(normalise(F.col("t")).alias("n")).collect()] == ["a\nb", "é", "fi x", "éü", "ab"]
