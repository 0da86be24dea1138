"""Classification and regression trees, null levels, minnumlevels."""

import pytest
from pyspark.sql import functions as F

from quiltspark.operators.generators.cart import CartSequential
from quiltspark.plans.manager import DisjointSynthesizer


def _rows(spark, n=600):
    # kind is a category whose order says nothing: y depends on kind in {0, 2, 4} against {1, 3, 5}
    return spark.range(n).select(
        F.col("id").alias("__row_id"), (F.col("id") % 6).cast("double").alias("kind"), F.when(F.col("id") % 2 == 0, 10.0).otherwise(20.0).alias("y"),
        F.when(F.col("id") % 6 == 3, F.lit(None)).otherwise(F.col("id").cast("double")).alias("x"),
        F.when(F.col("id") % 2 == 1, F.lit("odd")).alias("s"), F.lit(7).alias("same"), F.lit(None).cast("double").alias("none"))


def test_categories_nulls_and_constants(spark):
    train = _rows(spark)
    g = CartSequential(seed=1, categorical=["kind"]).fit(train)
    assert g.category == {"kind", "y", "s", "same", "none"}  # y: two values, fewer than minnumlevels
    got = g.sample(900, seed=2).collect()
    assert sorted(r["__row_id"] for r in got) == list(range(900))
    for r in got:
        odd = int(r["kind"]) % 2
        assert r["y"] == (20.0 if odd else 10.0) and r["s"] == ("odd" if odd else None)
        assert (r["x"] is None) == (r["kind"] == 3.0) and r["same"] == 7 and r["none"] is None
    assert {r["kind"] for r in got} == {float(k) for k in range(6)}


def test_minnumlevels_and_too_many_levels(spark):
    train = _rows(spark)
    assert CartSequential(seed=1, minnumlevels=7).fit(train.select("__row_id", "kind", "y")).category == {"kind", "y"}
    assert CartSequential(seed=1, minnumlevels=1).fit(train.select("__row_id", "kind", "y")).category == set()
    wide = CartSequential(seed=1, categorical=["x"], max_levels=50).fit(train.select("__row_id", "y", "x"))
    assert wide.category == {"y"}  # an ordered number instead
    with pytest.raises(ValueError):
        CartSequential(max_levels=50).fit(train.select("__row_id", F.col("__row_id").cast("string").alias("t")))


def test_same_seed_same_rows_whatever_the_layout(spark):
    train = _rows(spark)
    a = CartSequential(seed=3, categorical=["kind"]).generate(train, 200, seed=4)
    b = CartSequential(seed=3, categorical=["kind"]).generate(train.repartition(5), 200, seed=4)
    assert a.exceptAll(b).count() == 0


def test_manager_keeps_rows_with_nulls_and_knows_categories(spark):
    train = _rows(spark).select("kind", "y", "x", "s").withColumn("letter", F.concat(F.lit("k"), F.col("kind").cast("int").cast("string"))).drop("kind")
    ds = DisjointSynthesizer(train, [("cart", ["letter", "y", "x", "s"])], seed=5)
    got = ds.fit_generate().collect()
    assert len(got) == 600 and ds.n_train == 600
    assert all((r["x"] is None) == (r["letter"] == "k3") for r in got)
    assert all((r["s"] is None) == (r["letter"] in ("k0", "k2", "k4")) for r in got)


def test_a_sample_is_drawn_once(spark):
    """Counting a generator's rows does not work them out a second time."""
    from quiltspark.operators.generators.base import ROW_ID, Generator

    drawn = spark.sparkContext.accumulator(0)

    def draw(batches):
        for batch in batches:
            drawn.add(batch.num_rows)
            yield batch

    class Drawing(Generator):
        def fit(self, train):
            self._train, self._m = train, train.count()
            return self

        def sample(self, n, seed=0):
            return self._train.mapInArrow(draw, self._train.schema)

    train = spark.range(50).withColumnRenamed("id", ROW_ID)
    assert Drawing().generate(train, 50).count() == 50
    assert drawn.value == 50


def test_ranks_in_few_groups_are_the_same(spark):
    from quiltspark.operators.positions import value_position

    rows = [(None if i % 5 == 4 else i % 5 % 3, (i * 37) % 101, i) for i in range(100)]
    df = spark.createDataFrame(rows, "g int, x int, id int")
    ranked = [value_position(df, ["x", "id"], out="p", partition_col="g", ranges=7, few_groups=few) for few in (False, True)]
    expected = {r[2]: sum((o[1], o[2]) < (r[1], r[2]) for o in rows if o[0] == r[0]) for r in rows}
    assert [{r["id"]: r["p"] for r in d.collect()} for d in ranked] == [expected, expected]
