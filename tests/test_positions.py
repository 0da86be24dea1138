import random

from pyspark.sql import functions as F
from pyspark.sql import Window

from quiltspark.functions.keys import seeded_key
from quiltspark.operators.positions import cumulative_sum, dense_position, kth_value, value_position


def test_dense_position_equals_global_row_number(spark):
    df = spark.range(5000).withColumnRenamed("id", "__row_id")
    key = seeded_key(3, "t", "__row_id")
    ours = dense_position(df, key, "__row_id", digits=2).select("__row_id", "__pos")
    ref = df.withColumn("__ref", F.row_number().over(Window.orderBy(key, "__row_id")) - 1)
    diff = ours.join(ref, "__row_id").where(F.col("__pos") != F.col("__ref")).count()
    assert diff == 0
    assert sorted(r[0] for r in ours.select("__pos").collect()) == list(range(5000))


def test_dense_position_independent_of_layout(spark):
    df = spark.range(2000).withColumnRenamed("id", "__row_id")
    key = seeded_key(9, "x", "__row_id")
    a = {r[0]: r[1] for r in dense_position(df.repartition(3), key, "__row_id").select("__row_id", "__pos").collect()}
    b = {r[0]: r[1] for r in dense_position(df.repartition(17), key, "__row_id").select("__row_id", "__pos").collect()}
    assert a == b


def test_kth_value_matches_sort(spark):
    rnd = random.Random(1)
    vals = [rnd.choice([rnd.random(), 0.25, 0.5]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    s = sorted(vals)
    for k in (0, 1, 299, 1500, 2999):
        assert kth_value(df, "x", k, max_collect=50) == s[k]
        assert kth_value(df, "x", k, descending=True, max_collect=50) == s[len(s) - 1 - k]
    assert kth_value(df, "x", 3000) is None


def test_kth_value_on_long_keys(spark):
    df = spark.range(4000).select(F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 15), 16, 10).cast("long").alias("h"))
    s = sorted(r[0] for r in df.collect())
    assert kth_value(df, "h", 1234, max_collect=10) == s[1234]


def test_value_position_and_cumsum(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("ab"), rnd.random()) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    pos = value_position(df, ["v", "id"], out="p", partition_col="g", ranges=8).collect()
    for g in "ab":
        mine = sorted((r["p"], r["id"]) for r in pos if r["g"] == g)
        ref = sorted((v, i) for i, gg, v in rows if gg == g)
        assert [i for _, i in mine] == [i for _, i in ref]
    cs = {r["id"]: r["c"] for r in cumulative_sum(df, ["v", "id"], "v", "c", ranges=8).collect()}
    running, expect = 0.0, {}
    for v, i in sorted((v, i) for i, _, v in rows):
        running += v
        expect[i] = running
    assert all(abs(cs[i] - expect[i]) < 1e-9 for i in expect)


def test_a_hot_value_is_many_slices(spark):
    """Nine rows in ten share the first order column: they are dealt out all the same."""
    from quiltspark.operators.positions import sliced_in_order

    df = spark.range(4000).select("id", F.when(F.col("id") % 10 > 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"), F.lit(1.0).alias("w"))
    sizes = [r["count"] for r in sliced_in_order(df, ["v", "id"], 16).groupBy("__slice").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 4000 / 16
    want = {r["id"]: k for k, r in enumerate(sorted(df.collect(), key=lambda r: (r["v"], r["id"])))}
    assert {r["id"]: r["p"] for r in value_position(df, ["v", "id"], out="p", ranges=16).collect()} == want
    sums = cumulative_sum(df, ["v", "id"], "w", "s", inclusive=False, ranges=16)
    assert {r["id"]: r["s"] for r in sums.collect()} == {k: float(v) for k, v in want.items()}


def test_moving_average_across_blocks(spark):
    from quiltspark.operators.stats import moving_average

    rows = [(i, [None, "a", "b"][i % 3] if i % 7 else "a", float(i * 37 % 101), None if i % 11 == 0 else float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, o double, v double")
    want = {}
    for g in (None, "a", "b"):
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        for k, r in enumerate(mine):
            some = [x[3] for x in mine[max(0, k - 9) : k + 1] if x[3] is not None]
            want[r[0]] = round(sum(some) / len(some), 6) if some else None
    for block in (10, 13, 1000):
        got = moving_average(df, "o", "v", "g", "id", block_rows=block)
        assert got.columns == [*df.columns, "moving_avg"]
        assert {r["id"]: r["moving_avg"] for r in got.collect()} == want
