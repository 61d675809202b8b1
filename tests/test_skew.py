from pyspark.sql import functions as F

from gristmill.operators.skew import split_join
from gristmill.session import cut_lineage, spread


def test_hot_and_cold_keys_join_alike(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"), "id")
    right = left.filter("k is not null").select("k").distinct().withColumn("v", F.length("k"))
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, split_join(left, right, ["k"], counts, 500).collect())) == want
    outer = split_join(left, right, ["k"], counts, 500, "left")
    assert outer.count() == 3000 and outer.filter("v is null").count() == left.filter("k is null").count()


def test_cut_and_spread(spark):
    df = spark.range(10).coalesce(1)
    assert spread(df).rdd.getNumPartitions() >= 4 and sorted(r.id for r in spread(df).collect()) == list(range(10))
    assert sorted(r.id for r in cut_lineage(df).collect()) == list(range(10))


def test_never_more_than_so_many_hot_keys(spark):
    from gristmill.operators.skew import hot_from

    counts = spark.createDataFrame([(i, 10 + i % 90) for i in range(1000)], "k int, n long")
    assert hot_from(counts, 95).count() == sum(10 + i % 90 >= 95 for i in range(1000))
    assert 0 < hot_from(counts, 1, most_hot=700).count() <= 700
    assert hot_from(counts.limit(0), 1).count() == 0
