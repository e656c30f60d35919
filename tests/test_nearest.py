import random

import pytest
from pyspark.sql import functions as F

from sitometry.operators import nearest


def tables(spark, seed, n=60, spread=200):
    rng = random.Random(seed)
    place = lambda: rng.choice([None, *range(spread)]) if rng.random() < 0.1 else rng.randrange(-spread, spread)
    left = [(rng.choice(["a", "b", None]), place(), i) for i in range(n)] + [("a", 5, n), ("a", 5, n), ("c", 1, n + 1)]
    right = [(rng.choice(["a", "b", None]), place(), i, f"v{i}") for i in rng.sample(range(n), n)] + [("a", 4, 900, "x"), ("a", 6, 800, "y"), ("a", 6, 850, "z")]
    return left, right, spark.createDataFrame(left, "k string, tok int, own int"), spark.createDataFrame(right, "k string, tok int, seq int, value string")


@pytest.mark.parametrize(("seed", "window"), [(1, 0), (2, 3), (3, 25), (4, 1000)])
def test_nearest_and_within_equal_brute_force(spark, seed, window):
    left, right, a, b = tables(spark, seed)
    near = lambda x: sorted((abs(t - x[1]), s, v) for k, t, s, v in right if None not in (k, t, x[0], x[1]) and k == x[0] and abs(t - x[1]) <= window)
    got = nearest.nearest(a, b, ["k"], window).collect()
    assert sorted(((r["k"], r["tok"], r["own"], r["distance"], r["event"] and r["event"]["value"]) for r in got), key=repr) == sorted(((*x, *((n[0][0], n[0][2]) if (n := near(x)) else (None, None))) for x in left), key=repr)
    pairs = nearest.within(a, b, ["k"], window).collect()
    assert sorted((r["own"], r["distance"], r["event"]["seq"]) for r in pairs) == sorted((x[2], d, s) for x in left for d, s, _ in near(x))


def test_empty_sides(spark):
    *_, a, b = tables(spark, 5)
    assert nearest.nearest(a, b.limit(0), ["k"], 9).filter("event is not null").count() == 0
    assert nearest.nearest(a.limit(0), b, ["k"], 9).count() == nearest.within(a.limit(0), b, ["k"], 9).count() == 0


def test_one_giant_block_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        block = spark.range(100_000).select(F.lit("d").alias("k"), F.col("id").cast("int").alias("tok"), F.col("id").alias("seq"))
        out = nearest.nearest(block.filter("tok % 3 = 0"), block.filter("tok % 7 = 0"), ["k"], 80).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("task").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * min(sizes) and out.filter("tok < 99990 and (distance > 3 or event is null)").count() == 0
        pairs = nearest.within(block.filter("tok % 3 = 0"), block.filter("tok % 7 = 0"), ["k"], 6).withColumn("task", F.spark_partition_id())
        assert pairs.select("task").distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
