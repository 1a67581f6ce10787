from __future__ import annotations

from pyspark.sql import functions as F

from tests.helpers import rows
from threadlab.operators import skew


def test_a_hot_key_of_a_plain_join_is_split(spark):
    """The joins of threads and labels rely on it."""
    left = spark.range(400_000).select("id", F.lit(1).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
    left = left.unionByName(spark.range(4_000).select("id", (F.col("id") % 500).cast("int").alias("k"), F.lit("t").alias("t")))
    right = spark.range(500).select(F.col("id").cast("int").alias("k"), F.lit("v").alias("v"))
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
    }
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        joined = left.join(right, "k", "left")
        assert len(joined.collect()) == 404_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rank_in_groups_equals_window(spark, monkeypatch):
    df = spark.range(5_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        F.pmod(F.hash("id"), F.lit(97)).alias("a"), "id",
    )
    want = rows(skew.rank_in_groups(df, ["g"], ["a", "id"], "r", rows=5_000).select("id", "r"), "id")
    for limit, named in ((10, 1_000), (10, 3), (500, 1_000)):
        monkeypatch.setattr(skew, "MAX_NAMED", named)
        got = skew.rank_in_groups(df, ["g"], ["a", "id"], "r", hot_rows=limit)
        assert got.columns == ["g", "a", "id", "r"]
        assert rows(got.select("id", "r"), "id") == want


def test_lookup_join_beyond_its_bound(spark):
    left = spark.range(100).select("id", (F.col("id") % 7).alias("k"))
    right = spark.range(5).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    small = rows(skew.lookup_join(left, right, ["k"]).select("id", "v"), "id")
    large = rows(skew.lookup_join(left, right, ["k"], max_rows=2).select("id", "v"), "id")
    assert small == large and len(small) == 100
    assert skew.checked_broadcast(right, 4) is None
