from pyspark.sql import functions as F

from syntenia.plans.ranks import ranked


def test_ranks_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k"), (F.col("id") % 5).alias("n"))
        found = ranked(df, F.col("n").desc(), "k").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["k"] for r in sorted(found, key=lambda r: r["_rank"])] == [r["k"] for r in sorted(found, key=lambda r: (-r["n"], r["k"]))]
    assert sorted(r["_rank"] for r in found) == list(range(1, 1001))


def test_ranks_of_nothing_and_of_null(spark):
    assert ranked(spark.range(0), "id").collect() == []
    found = ranked(spark.createDataFrame([(None,), (2,), (1,)], "k long"), "k", name="at").collect()
    assert {r["k"]: r["at"] for r in found} == {None: 1, 1: 2, 2: 3}
