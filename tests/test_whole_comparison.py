"""The registered comparison runs the validated join with the limits of its preset."""

from quiltspark.operators import joins as J
from quiltspark.plans import registry


def test_comparison_has_the_limits_of_the_preset(spark, monkeypatch):
    made = []
    monkeypatch.setattr(registry, "orders_with_id", lambda *_: spark.createDataFrame([], "__row_id long, o_orderstatus string, o_totalprice double, o_custkey long, o_orderpriority string"))
    monkeypatch.setattr(registry.H, "validator_comparison", lambda parts, validators, make_join, *_, **__: [(n, "m", float(made.append(make_join(v)) is None)) for n, v in validators.items()])
    assert registry.q_validator_comparison(spark, "").count() == 1
    assert [j.cfg for j in made] == [J.ADAPTIVE] and made[0].max_size is None


def test_the_loop_is_the_rounds_of_the_sql(spark):
    """Two rounds of the class are the two rounds that the registered SQL spells out."""
    import duckdb

    from paths import SF0001
    from quiltspark.sources.tables import orders_parts

    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{SF0001}/orders.parquet')")
    join = J.ValidatedJoin(registry.SCORER, behaviour="adaptive", seed=registry.SEED, max_iter=2)
    out = join.join(orders_parts(spark, SF0001))
    got = sorted((r["__round"], r["__id_split0"], r["__id_split1"]) for r in out.collect())
    want = con.sql(registry.SQL["J5_accumulate_rounds"]).project("__round, __id_split0, __id_split1").fetchall()
    assert got == sorted(want) and join.stop_ == "max_iter"


def test_parts_of_unequal_length_keep_their_rest(spark):
    """What one part has more is paired with nothing, round after round, and lost by none."""
    from pyspark.sql import functions as F

    from quiltspark.operators.validators import LinearScoreValidator

    a = spark.range(30).select(F.col("id").alias("__row_id"), (F.col("id") / 30).alias("x"))
    b = spark.range(50).select(F.col("id").alias("__row_id"), (F.col("id") / 50).alias("y"))
    join = J.ValidatedJoin(LinearScoreValidator({"x": 2.0, "y": -2.0}), behaviour="strict", seed=3, max_iter=12)
    rows = join.join({"a": a, "b": b}).collect()
    ids = [[r[f"__id_{n}"] for r in rows if r[f"__id_{n}"] is not None] for n in "ab"]
    assert all(len(set(i)) == len(i) for i in ids) and all(r["x"] is not None and r["y"] is not None for r in rows)
    assert [h["pool"] for h in join.history][0] == 30
    assert all(p["pool"] - p["accepted"] == q["pool"] for p, q in zip(join.history, join.history[1:], strict=False))
