"""Registered queries: one per operator of the survey inventory.

Each entry is ``(spark, sf_dir) -> DataFrame`` over the whole benchmark tables,
paired (where SQL can say it) with an ANSI/DuckDB oracle over the same tables.
Computed columns carry the same alias on both sides; doubles are rounded in
both so value hashes compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltspark.functions.keys import sql_key, sql_key_to_long
from quiltspark.operators import joins as J
from quiltspark.operators import privacy as P
from quiltspark.operators import sampling as M
from quiltspark.operators.positions import kth_value
from quiltspark.operators.validators import LinearScoreValidator
from quiltspark.sources.tables import ROW_ID, orders_parts, orders_with_id, table

SEED = 7
AUTO_P = 0.1
# the fixed pre-fitted scorer used wherever a validator must be oracle-checkable
SCORER = LinearScoreValidator({"o_totalprice": 1e-05, "o_custkey": -0.002}, bias=0.0, digits=9)
SCORE_SQL = (
    "round(1.0 / (1.0 + exp(-((0.0 + CAST(o_totalprice AS DOUBLE) * 1e-05) "
    "+ CAST(o_custkey AS DOUBLE) * -0.002))), 9)"
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


def rank_sql(seed: int, tag: str, id_expr: str) -> str:
    return f"(row_number() OVER (ORDER BY {sql_key(seed, tag, id_expr)}, {id_expr}) - 1)"


def draw_sql(seed: int, tag: str, j_expr: str, n_expr: str) -> str:
    return f"({sql_key_to_long(sql_key(seed, tag, j_expr))} % ({n_expr}))"


N_ORDERS = "(SELECT count(*) FROM orders)"

# ---------------------------------------------------------------------------
# scans, projections, positional joins
# ---------------------------------------------------------------------------


@register("S2_scan_parquet", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def q_scan(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@register("P1_project_splits", "SELECT o_orderkey AS __row_id, o_custkey, o_orderpriority FROM orders")
def q_project(spark, sf):
    return orders_parts(spark, sf)["split1"]


@register(
    "J1_concatenate",
    "SELECT o_orderkey AS __row_id, o_orderstatus, o_totalprice, o_custkey, o_orderpriority FROM orders",
)
def q_concat(spark, sf):
    return J.concatenate(orders_parts(spark, sf))


_J2_SQL = f"""
WITH a AS (SELECT o_orderkey AS __id_split0, o_orderstatus, o_totalprice,
                  {rank_sql(SEED, 'split0', 'o_orderkey')} AS __pos FROM orders),
     b AS (SELECT o_orderkey AS __id_split1, o_custkey, o_orderpriority,
                  {rank_sql(SEED, 'split1', 'o_orderkey')} AS __pos FROM orders)
SELECT __pos, __id_split0, o_orderstatus, o_totalprice, __id_split1, o_custkey, o_orderpriority
FROM a JOIN b USING (__pos)
"""


@register("J2_random_join", _J2_SQL)
def q_random_join(spark, sf):
    return J.random_join(orders_parts(spark, sf), SEED)


@register("M1_shuffle_rows", f"SELECT o_orderkey AS __row_id, {rank_sql(SEED, 'shuffle', 'o_orderkey')} AS __pos FROM orders")
def q_shuffle(spark, sf):
    return M.shuffle_rows(orders_with_id(spark, sf).select(ROW_ID), SEED)


@register(
    "M8_head_n",
    f"SELECT * FROM ({_J2_SQL}) WHERE __pos < (SELECT count(*) // 2 FROM orders)",
)
def q_head(spark, sf):
    parts = orders_parts(spark, sf)
    n = parts["split0"].count()
    return M.head_n(J.random_join(parts, SEED), n // 2, id_col=J.POS)


@register(
    "M2_bootstrap_exact",
    f"""
WITH d AS (SELECT o_orderkey * 2 + r.range AS j FROM orders CROSS JOIN range(2) r),
     dd AS (SELECT j, {draw_sql(SEED, 'boot', 'j', N_ORDERS)} AS draw FROM d)
SELECT j, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
FROM dd JOIN orders ON dd.draw = orders.o_orderkey
""",
)
def q_bootstrap(spark, sf):
    o = orders_with_id(spark, sf).select(ROW_ID, "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return M.bootstrap_exact(o, 2, SEED)


_M3_SQL = f"""
WITH d AS (SELECT o_orderkey * 2 + r.range AS j FROM orders CROSS JOIN range(2) r),
     e AS (SELECT j, {draw_sql(SEED, 'pos', 'j', N_ORDERS)} AS kp, {draw_sql(SEED, 'neg:split0', 'j', N_ORDERS)} AS k0,
                  {draw_sql(SEED, 'neg:split1', 'j', N_ORDERS)} AS k1 FROM d),
     pos AS (SELECT j, 1 AS label, o.o_orderstatus, o.o_totalprice, o.o_custkey, o.o_orderpriority
             FROM e JOIN orders o ON o.o_orderkey = e.kp),
     n0 AS (SELECT j, o.o_orderstatus, o.o_totalprice FROM e JOIN orders o ON o.o_orderkey = e.k0),
     n1 AS (SELECT j, o.o_custkey, o.o_orderpriority FROM e JOIN orders o ON o.o_orderkey = e.k1),
     neg AS (SELECT j, 0 AS label, o_orderstatus, o_totalprice, o_custkey, o_orderpriority FROM n0 JOIN n1 USING (j))
SELECT * FROM pos UNION ALL SELECT * FROM neg
"""


def _training(spark, sf):
    return M.setup_training_data(orders_parts(spark, sf), 2, seed=SEED)


@register("M3_training_data", _M3_SQL)
def q_training(spark, sf):
    return _training(spark, sf)


@register(
    "M4_subsample_negatives",
    f"""
WITH t AS ({_M3_SQL}),
     neg AS (SELECT *, row_number() OVER (ORDER BY {sql_key_to_long(sql_key(SEED, 'subneg', 'j'))}, j) AS rn
             FROM t WHERE label = 0)
SELECT * FROM t WHERE label = 1
UNION ALL
SELECT j, label, o_orderstatus, o_totalprice, o_custkey, o_orderpriority FROM neg
WHERE rn <= (SELECT count(*) // 6 FROM t WHERE label = 0)
""",
)
def q_subsample(spark, sf):
    return M.subsample_negatives(_training(spark, sf), SEED)


@register(
    "M5_kfold_assign",
    f"""
WITH r AS (SELECT o_orderkey, {rank_sql(SEED, 'fold', 'o_orderkey')} AS p FROM orders),
     c AS (SELECT count(*) // 5 AS q, count(*) % 5 AS rem FROM orders)
SELECT o_orderkey AS __row_id,
       CAST(CASE WHEN p < rem * (q + 1) THEN p // (q + 1) ELSE rem + (p - rem * (q + 1)) // q END AS INTEGER) AS fold
FROM r, c
""",
)
def q_kfold(spark, sf):
    return M.kfold_assign(orders_with_id(spark, sf).select(ROW_ID), 5, SEED)


@register(
    "S7_train_test_split",
    f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {sql_key_to_long(sql_key(42, 'split', 'o_orderkey'))},
                  o_orderkey) AS rn FROM orders)
SELECT o_orderkey AS __row_id, CASE WHEN rn <= (SELECT round(0.8 * count(*)) FROM orders) THEN 'train' ELSE 'test' END AS part
FROM r
""",
)
def q_train_test(spark, sf):
    o = orders_with_id(spark, sf).select(ROW_ID)
    train, test = M.train_test_split(o, 0.8, seed=42)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@register(
    "M7_top_up",
    f"""
WITH m AS (SELECT count(*) AS m FROM customer),
     extra AS (SELECT g.generate_series AS j FROM generate_series(
                  (SELECT m FROM m), (SELECT count(*) FROM orders) - 1) g),
     draws AS (SELECT j, {draw_sql(SEED, 'topup', 'j', '(SELECT m FROM m)')} AS draw FROM extra)
SELECT c_custkey AS __row_id, c_nationkey, c_acctbal, c_mktsegment FROM customer
UNION ALL
SELECT j AS __row_id, c_nationkey, c_acctbal, c_mktsegment FROM draws JOIN customer ON draws.draw = customer.c_custkey
""",
)
def q_top_up(spark, sf):
    cust = table(spark, sf, "customer").select(
        F.col("c_custkey").alias(ROW_ID), "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    n = table(spark, sf, "orders").count()
    return M.top_up_samples(cust, n, SEED)


# ---------------------------------------------------------------------------
# one validated round with a fixed scorer (J3 core, V5, W4, P3, A5, J4, J5)
# ---------------------------------------------------------------------------

_ROUND0_SQL = f"""
a0 AS (SELECT o_orderkey AS id0, o_totalprice, {rank_sql(SEED, 'split0:r0', 'o_orderkey')} AS pos FROM orders),
b0 AS (SELECT o_orderkey AS id1, o_custkey, {rank_sql(SEED, 'split1:r0', 'o_orderkey')} AS pos FROM orders),
j0 AS (SELECT pos, id0, id1, {SCORE_SQL} AS score FROM a0 JOIN b0 USING (pos)),
t AS (SELECT score AS thr FROM j0 ORDER BY score DESC
      LIMIT 1 OFFSET (SELECT CAST(floor({AUTO_P} * count(*)) AS BIGINT) FROM orders)),
acc0 AS (SELECT 0 AS __round, pos AS __pos, id0 AS __id_split0, id1 AS __id_split1 FROM j0, t WHERE score >= thr)
"""


def _round0(spark, sf):
    parts = orders_parts(spark, sf)
    n = parts["split0"].count()
    cand = J.random_join(parts, SEED, tag=":r0", n_rows=n)
    scored = SCORER.score(cand)
    thr = kth_value(scored, "score", int(AUTO_P * n), descending=True)
    acc = scored.where(F.col("score") >= F.lit(thr)).select(
        F.lit(0).alias("__round"), J.POS, "__id_split0", "__id_split1"
    )
    return parts, n, scored, thr, acc


@register("W4_auto_threshold", f"WITH {_ROUND0_SQL} SELECT thr AS threshold FROM t")
def q_auto_threshold(spark, sf):
    _, _, _, thr, _ = _round0(spark, sf)
    return spark.createDataFrame([(float(thr),)], "threshold double")


@register("J3_validated_round", f"WITH {_ROUND0_SQL} SELECT * FROM acc0")
def q_round(spark, sf):
    return _round0(spark, sf)[4]


@register(
    "V5_validate",
    f"WITH {_ROUND0_SQL} SELECT pos AS __pos, id0 AS __id_split0, id1 AS __id_split1, score FROM j0, t WHERE score >= thr",
)
def q_validate(spark, sf):
    parts = orders_parts(spark, sf)
    cand = J.random_join(parts, SEED, tag=":r0")
    acc, _ = SCORER.validate(cand, "auto", AUTO_P)
    return acc.select(J.POS, "__id_split0", "__id_split1", "score")


@register(
    "P3_threshold_filter",
    f"WITH {_ROUND0_SQL} SELECT pos AS __pos, score FROM j0 WHERE score >= 0.5",
)
def q_threshold(spark, sf):
    cand = J.random_join(orders_parts(spark, sf), SEED, tag=":r0")
    return SCORER.score(cand).where(F.col("score") >= 0.5).select(J.POS, "score")


@register(
    "A5_good_join_fraction",
    f"WITH {_ROUND0_SQL} SELECT round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END), 9) AS good_fraction FROM j0",
)
def q_good_fraction(spark, sf):
    cand = J.random_join(orders_parts(spark, sf), SEED, tag=":r0")
    return SCORER.score(cand).agg(
        F.round(F.avg((F.col("score") >= 0.5).cast("double")), 9).alias("good_fraction")
    )


@register(
    "J4_pool_subtract",
    f"WITH {_ROUND0_SQL} SELECT o_orderkey AS __row_id, o_orderstatus, o_totalprice FROM orders "
    "WHERE o_orderkey NOT IN (SELECT __id_split0 FROM acc0)",
)
def q_pool_subtract(spark, sf):
    parts, _, _, _, acc = _round0(spark, sf)
    return J.pool_subtract(parts["split0"], acc.select(F.col("__id_split0").alias(ROW_ID)))


_ROUND1_SQL = f"""
a1 AS (SELECT o_orderkey AS id0, o_totalprice, {rank_sql(SEED, 'split0:r1', 'o_orderkey')} AS pos FROM orders
       WHERE o_orderkey NOT IN (SELECT __id_split0 FROM acc0)),
b1 AS (SELECT o_orderkey AS id1, o_custkey, {rank_sql(SEED, 'split1:r1', 'o_orderkey')} AS pos FROM orders
       WHERE o_orderkey NOT IN (SELECT __id_split1 FROM acc0)),
j1 AS (SELECT pos, id0, id1, {SCORE_SQL} AS score FROM a1 JOIN b1 USING (pos)),
acc1 AS (SELECT 1 AS __round, pos AS __pos, id0 AS __id_split0, id1 AS __id_split1 FROM j1, t WHERE score >= thr)
"""


@register("J5_accumulate_rounds", f"WITH {_ROUND0_SQL}, {_ROUND1_SQL} SELECT * FROM acc0 UNION ALL SELECT * FROM acc1")
def q_accumulate(spark, sf):
    parts, n, _, thr, acc0 = _round0(spark, sf)
    pools = {
        name: J.pool_subtract(p, acc0.select(F.col(f"__id_{name}").alias(ROW_ID))) for name, p in parts.items()
    }
    cand = J.random_join(pools, SEED, tag=":r1")
    acc1 = SCORER.score(cand).where(F.col("score") >= F.lit(thr)).select(
        F.lit(1).alias("__round"), J.POS, "__id_split0", "__id_split1"
    )
    return J.accumulate([acc0, acc1])


@register("J3_validated_join")
def q_validated_join(spark, sf):
    """Round loop with the limits of the adaptive preset, no bound on rows (rows-only check: a driver loop)."""
    return J.ValidatedJoin(SCORER, behaviour="adaptive", seed=SEED).join(orders_parts(spark, sf))


# ---------------------------------------------------------------------------
# correlation matrix and column splitting
# ---------------------------------------------------------------------------

from itertools import combinations  # noqa: E402

from quiltspark.operators import aggregates as A  # noqa: E402
from quiltspark.operators import splits as C  # noqa: E402
from quiltspark.operators import stats as S  # noqa: E402
from quiltspark.operators.encode import OrdinalEncoder  # noqa: E402

L_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]
L_SPLITS = {"split0": ["l_quantity", "l_extendedprice", "l_discount"], "split1": ["l_tax", "l_linenumber", "l_partkey", "l_suppkey"]}


def corr_sql(a: str, b: str, table_name: str = "lineitem", absolute: bool = True) -> str:
    r = (f"coalesce(covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) / "
         f"nullif(stddev_pop(CAST({a} AS DOUBLE)) * stddev_pop(CAST({b} AS DOUBLE)), 0), 0.0)")
    return f"abs({r})" if absolute else r


def _pairs_sql(cols, absolute=True, table_name="lineitem"):
    """Long (col_a, col_b, r) over ordered pairs plus a zero diagonal."""
    sel = []
    for a, b in combinations(cols, 2):
        v = corr_sql(a, b, table_name, absolute)
        sel.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {v} AS r FROM {table_name}")
        sel.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {v} AS r FROM {table_name}")
    for c in cols:
        sel.append(f"SELECT '{c}' AS col_a, '{c}' AS col_b, 0.0 AS r")
    return "\nUNION ALL\n".join(sel)


def _lineitem(spark, sf):
    return table(spark, sf, "lineitem")


@register("A3_correlation_matrix", f"SELECT col_a, col_b, round(r, 6) AS r FROM ({_pairs_sql(L_NUM)})")
def q_corr(spark, sf):
    return C.correlation_long(_lineitem(spark, sf), L_NUM).select("col_a", "col_b", F.round("r", 6).alias("r"))


def _split_case(col, splits):
    whens = " ".join(f"WHEN {col} IN ({', '.join(repr(c) for c in cols)}) THEN '{s}'" for s, cols in splits.items())
    return f"CASE {whens} END"


@register(
    "C6_ratio_of_correlations",
    f"""
WITH p AS ({_pairs_sql(L_NUM)}),
     b AS (SELECT {_split_case('col_a', L_SPLITS)} AS sa, {_split_case('col_b', L_SPLITS)} AS sb,
                  sqrt(sum(r * r)) AS norm FROM p GROUP BY ALL),
     s AS (SELECT sum(CASE WHEN sa = sb THEN norm ELSE 0.0 END) AS interior,
                  sum(CASE WHEN sa <> sb THEN norm ELSE 0.0 END) AS exterior FROM b)
SELECT round(interior, 6) AS interior, round(exterior, 6) AS exterior,
       round(exterior / nullif(interior, 0), 6) AS ratio FROM s
""",
)
def q_ratio(spark, sf):
    return C.ratio_of_correlations(C.correlation_long(_lineitem(spark, sf), L_NUM), L_SPLITS)


def _norm_sql(pairs, signed=True):
    terms = " + ".join(f"power({corr_sql(a, b, absolute=not signed)}, 2)" for a, b in pairs) or "0.0"
    return terms


_S0, _S1 = L_SPLITS["split0"], L_SPLITS["split1"]


@register(
    "C8_intra_inter_correlation",
    f"""
WITH v AS (SELECT sqrt(2 * ({_norm_sql(list(combinations(_S0, 2)))})) AS corr_11,
                  sqrt(2 * ({_norm_sql(list(combinations(_S1, 2)))})) AS corr_22,
                  sqrt({_norm_sql([(a, b) for a in _S0 for b in _S1])}) AS corr_12,
                  sqrt({_norm_sql([(b, a) for a in _S0 for b in _S1])}) AS corr_21 FROM lineitem)
SELECT round(corr_11, 6) AS corr_11, round(corr_22, 6) AS corr_22, round(corr_12, 6) AS corr_12,
       round(corr_21, 6) AS corr_21, round(corr_11 + corr_22, 6) AS corr_intra,
       round(corr_12 + corr_21, 6) AS corr_inter FROM v
""",
)
def q_intra_inter(spark, sf):
    return C.intra_inter_correlation(_lineitem(spark, sf), _S0, _S1)


@register(
    "C7_measure_correlation",
    f"SELECT round(sqrt({_norm_sql([(a, b) for a in _S0 for b in _S1])}), 6) AS norm FROM lineitem",
)
def q_measure_corr(spark, sf):
    long = C.signed_with_diagonal(_lineitem(spark, sf), L_NUM)
    return C.measure_correlation(long, _S0, _S1).select(F.round("norm", 6).alias("norm"))


_UPPER = list(combinations(range(len(L_NUM)), 2))


@register(
    "W5_largest_pair",
    "WITH p AS (" + "\nUNION ALL\n".join(
        f"SELECT {i} AS i, {j} AS j, '{L_NUM[i]}' AS col_a, '{L_NUM[j]}' AS col_b, {corr_sql(L_NUM[i], L_NUM[j])} AS r FROM lineitem"
        for i, j in _UPPER
    ) + ") SELECT col_a, col_b, round(r, 6) AS r FROM p ORDER BY r DESC, i, j LIMIT 1",
)
def q_largest_pair(spark, sf):
    m = C.correlation_matrix(_lineitem(spark, sf), L_NUM)
    i, j = C.largest_pair(m, list(range(len(L_NUM))))
    return spark.createDataFrame([(L_NUM[i], L_NUM[j], round(float(m[i, j]), 6))], "col_a string, col_b string, r double")


@register("C3_correlated_split")
def q_correlated_split(spark, sf):
    """Greedy correlation-driven split of lineitem's numeric columns (driver loop on d x d)."""
    return C.splits_frame(spark, C.correlated_distribute_columns(_lineitem(spark, sf), L_NUM, 2, seed=SEED))


# ---------------------------------------------------------------------------
# encoding (E1, E2), distinct counts
# ---------------------------------------------------------------------------


def _part(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")


@register(
    "E1_ordinal_encode",
    "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS p_brand, "
    "CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS DOUBLE) AS p_type, p_size, p_retailprice FROM part",
)
def q_encode(spark, sf):
    p = _part(spark, sf)
    return OrdinalEncoder(["p_brand", "p_type"]).fit(p).transform(p)


@register("E2_ordinal_decode", "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part")
def q_decode(spark, sf):
    p = _part(spark, sf)
    enc = OrdinalEncoder(["p_brand", "p_type"]).fit(p)
    return enc.inverse_transform(enc.transform(p))


_PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_DISTINCT_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM part" for c in _PART_COLS
)


@register("A4_distinct_counts", _DISTINCT_SQL)
def q_distinct(spark, sf):
    return A.distinct_counts(table(spark, sf, "part"), _PART_COLS)


@register(
    "P8_classify_columns",
    "SELECT \"column\", n_distinct, CASE WHEN \"column\" IN ('p_name', 'p_brand', 'p_type') OR n_distinct <= 5 "
    f"THEN 'categorical' ELSE 'numeric' END AS kind FROM ({_DISTINCT_SQL})",
)
def q_classify(spark, sf):
    return A.classify_columns(table(spark, sf, "part").select(*_PART_COLS))


# ---------------------------------------------------------------------------
# real vs synthetic halves of orders
# ---------------------------------------------------------------------------

_HALVES_SQL = f"""
hr AS (SELECT *, row_number() OVER (ORDER BY {sql_key_to_long(sql_key(42, 'split', 'o_orderkey'))}, o_orderkey) AS __rn
       FROM orders),
halves AS (SELECT *, CASE WHEN __rn <= (SELECT round(0.5 * count(*)) FROM orders) THEN 'Real' ELSE 'Synthetic' END AS data
           FROM hr)
"""


def _halves(spark, sf):
    o = orders_with_id(spark, sf)
    return M.train_test_split(o, 0.5, seed=42)


@register("P9_tag_real_synthetic", f"WITH {_HALVES_SQL} SELECT o_orderkey AS __row_id, o_totalprice, data FROM halves")
def q_tag(spark, sf):
    real, syn = _halves(spark, sf)
    return A.tag_real_synthetic(real.select(ROW_ID, "o_totalprice"), syn.select(ROW_ID, "o_totalprice"))


@register("W7_complement", f"WITH {_HALVES_SQL} SELECT o_orderkey AS __row_id FROM halves WHERE data = 'Synthetic'")
def q_complement(spark, sf):
    o = orders_with_id(spark, sf).select(ROW_ID)
    real, _ = M.train_test_split(o, 0.5, seed=42)
    return A.complement(o, real, ROW_ID)


@register("S6_load_and_union", "SELECT o_orderkey AS __row_id, o_custkey, o_totalprice FROM orders")
def q_load_union(spark, sf):
    cols, base = [ROW_ID, "o_custkey", "o_totalprice"], IO.scratch_path(spark, "halves")
    for df, name in zip(_halves(spark, sf), ("train", "test"), strict=True):
        df.select(*cols).write.parquet(f"{base}_{name}")
    return IO.load_and_union(spark, base)


def _bins_sql(col, bins=10):
    lo, hi = f"(SELECT min({col}) FROM orders)", f"(SELECT max({col}) FROM orders)"
    return (f"CAST(CAST(least(floor((CAST({col} AS DOUBLE) - {lo}) / (({hi} - {lo}) / {float(bins)})), {bins - 1}) "
            f"AS BIGINT) AS VARCHAR)")


_HIST_LONG_SQL = f"""
long AS (SELECT 'o_totalprice' AS attribute, data, {_bins_sql('o_totalprice')} AS bucket FROM halves
         UNION ALL SELECT 'o_orderstatus', data, o_orderstatus FROM halves
         UNION ALL SELECT 'o_orderpriority', data, o_orderpriority FROM halves)
"""


@register(
    "A6_attribute_histogram",
    f"""WITH {_HALVES_SQL}, {_HIST_LONG_SQL},
c AS (SELECT attribute, data, bucket, count(*) AS n FROM long GROUP BY ALL),
t AS (SELECT attribute, data, count(*) AS total FROM long GROUP BY ALL)
SELECT attribute, data, bucket, round(n / total, 6) AS share FROM c JOIN t USING (attribute, data)""",
)
def q_attr_hist(spark, sf):
    real, syn = _halves(spark, sf)
    return A.attribute_histogram(real, syn, ["o_orderstatus", "o_orderpriority"], ["o_totalprice"])


@register(
    "U1_hellinger",
    f"""WITH {_HALVES_SQL}, {_HIST_LONG_SQL},
c AS (SELECT attribute AS "column", bucket, sum(CASE WHEN data = 'Real' THEN 1.0 ELSE 0.0 END) AS nr,
             sum(CASE WHEN data = 'Synthetic' THEN 1.0 ELSE 0.0 END) AS ns FROM long GROUP BY ALL),
t AS (SELECT "column", sum(nr) AS tr, sum(ns) AS ts FROM c GROUP BY ALL),
h AS (SELECT "column", sqrt(greatest(0.0, 1.0 - sum(sqrt((nr / tr) * (ns / ts))))) AS h FROM c JOIN t USING ("column")
      GROUP BY ALL)
SELECT "column", round(h, 6) AS h_dist FROM h
UNION ALL SELECT 'avg_h_dist', round(avg(h), 6) FROM h""",
)
def q_hellinger(spark, sf):
    from quiltspark.operators.metrics import hellinger

    real, syn = _halves(spark, sf)
    return hellinger(real, syn, ["o_orderstatus", "o_orderpriority"], ["o_totalprice"])


# ---------------------------------------------------------------------------
# validator diagnostics on the labelled training set
# ---------------------------------------------------------------------------


@register("A7_probability_histogram",
          f"WITH {_ROUND0_SQL} SELECT CAST(least(floor(score * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM j0 GROUP BY ALL")
def q_prob_hist(spark, sf):
    cand = J.random_join(orders_parts(spark, sf), SEED, tag=":r0")
    return A.probability_histogram(SCORER.score(cand), "score", 20)


_SCORED_TRAIN_SQL = f"st AS (SELECT label, {SCORE_SQL} AS score FROM ({_M3_SQL}))"


@register(
    "A8_calibration_curve",
    f"""WITH {_SCORED_TRAIN_SQL}
SELECT CAST(least(greatest(ceil(score * 10) - 1, 0), 9) AS INTEGER) AS bin, round(avg(score), 6) AS mean_pred,
       round(avg(CAST(label AS DOUBLE)), 6) AS frac_pos, count(*) AS n FROM st GROUP BY ALL""",
)
def q_calibration(spark, sf):
    return A.calibration_curve(SCORER.score(_training(spark, sf)), "score", "label", 10)


@register(
    "A8_calibration_pair",
    f"""WITH t AS ({_M3_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY
        CAST(('0x' || substr(md5('{SEED}:holdout:' || CAST(label AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 15)) AS BIGINT), j) AS rn,
        count(*) OVER (PARTITION BY label) AS nc FROM t),
st AS (SELECT CASE WHEN rn <= (nc + 4) // 5 THEN 2 ELSE 1 END AS k, label, {SCORE_SQL} AS score FROM r)
SELECT k, CAST(least(greatest(ceil(score * 10) - 1, 0), 9) AS INTEGER) AS bin, round(avg(score), 6) AS mean_pred,
       round(avg(CAST(label AS DOUBLE)), 6) AS frac_pos, count(*) AS n FROM st GROUP BY ALL""",
)
def q_calibration_pair(spark, sf):
    """Calibration of the fixed scorer on the training rows and on the held-out fifth of each class."""
    train, holdout = M.holdout_split(_training(spark, sf), 5, SEED)
    return A.calibration_pair(SCORER.score(train), SCORER.score(holdout), "score", "label", 10)


@register(
    "V11_score_validator",
    f"""WITH {_SCORED_TRAIN_SQL},
r AS (SELECT label, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ar FROM st),
a AS (SELECT (sum(CASE WHEN label = 1 THEN ar ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0)
             / (sum(label) * sum(1 - label)) AS auc FROM r),
m AS (SELECT avg((score - label) * (score - label)) AS brier,
             avg(-(label * ln(least(greatest(score, 1e-15), 1 - 1e-15))
                   + (1 - label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))) AS log_loss,
             sum(CASE WHEN score >= 0.5 AND label = 1 THEN 1.0 ELSE 0.0 END) AS tp,
             sum(CASE WHEN score >= 0.5 AND label = 0 THEN 1.0 ELSE 0.0 END) AS fp,
             sum(CASE WHEN score < 0.5 AND label = 1 THEN 1.0 ELSE 0.0 END) AS fn FROM st)
SELECT round(brier, 3) AS brier, round(log_loss, 3) AS log_loss, round(auc, 3) AS auc,
       round(coalesce(tp / nullif(tp + fp, 0), 0.0), 3) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 3) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 3) AS f1 FROM m, a""",
)
def q_score_validator(spark, sf):
    return S.score_validator(SCORER.score(_training(spark, sf)), "score", "label", 0.5)


# ---------------------------------------------------------------------------
# result tables: lineitem read as a run log (model = l_returnflag,
# data = l_linestatus, rep = l_linenumber, metrics = quantity/discount/tax)
# ---------------------------------------------------------------------------

from quiltspark.sources import io as IO  # noqa: E402

METRICS = ["l_quantity", "l_discount", "l_tax"]
MODELS = ["A", "N", "R"]
_LONG_SQL = "\nUNION ALL\n".join(
    f"SELECT l_returnflag AS model, l_linestatus AS data, l_linenumber AS rep, '{m}' AS metric, "
    f"CAST({m} AS DOUBLE) AS value FROM lineitem"
    for m in METRICS
)
_A1_SQL = (f"SELECT model, metric, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem "
           f"FROM ({_LONG_SQL}) GROUP BY ALL")


def _runs_wide(spark, sf):
    li = _lineitem(spark, sf)
    return li.select(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("data"), F.col("l_linenumber").alias("rep"),
        *METRICS,
    )


def _runs_long(spark, sf):
    return A.metrics_to_long(_runs_wide(spark, sf), ["model", "data", "rep"], METRICS)


def _a1(spark, sf):
    return A.mean_sem(_runs_long(spark, sf), ["model", "metric"])


@register("P5_metrics_to_long", _LONG_SQL)
def q_to_long(spark, sf):
    return _runs_long(spark, sf)


@register("A1_mean_sem", _A1_SQL)
def q_mean_sem(spark, sf):
    return _a1(spark, sf)


@register(
    "A9_group_point_estimates",
    "SELECT l_returnflag AS model, l_linestatus AS data, round(avg(l_quantity), 6) AS mean, "
    "round(stddev_samp(l_quantity), 6) AS sd, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 6) AS sem, "
    "count(*) AS n FROM lineitem GROUP BY ALL",
)
def q_point_estimates(spark, sf):
    return A.group_point_estimates(_runs_wide(spark, sf), ["model", "data"], "l_quantity")


_RANK_SQL = (f"SELECT model, metric, mean, sem, rank() OVER (PARTITION BY metric ORDER BY "
             f"CASE WHEN metric IN ('l_quantity') THEN -mean ELSE mean END) AS rank FROM ({_A1_SQL})")


@register("W1_rank_models", _RANK_SQL)
def q_rank_models(spark, sf):
    return S.rank_models(_a1(spark, sf), maximise=["l_quantity"])


@register(
    "W3_benchmark_rank",
    f"SELECT model, CAST(sum(rank) AS BIGINT) AS rank_sum, CAST(sum(CASE WHEN metric IN ('l_discount', 'l_tax') "
    f"THEN rank ELSE 0 END) AS BIGINT) AS u_rank FROM ({_RANK_SQL}) GROUP BY ALL",
)
def q_benchmark_rank(spark, sf):
    return S.benchmark_rank(_a1(spark, sf), maximise=["l_quantity"], groups={"u_rank": ["l_discount", "l_tax"]})


def _erf_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.3275911 * abs({x})))"
    poly = f"(((((1.061405429 * {t} + -1.453152027) * {t} + 1.421413741) * {t} + -0.284496736) * {t} + 0.254829592) * {t})"
    return f"(sign({x}) * (1.0 - {poly} * exp(-abs({x}) * abs({x}))))"


_Z = "((ma - mb) / nullif(sqrt(sa * sa + sb * sb), 0))"


@register(
    "F1_compare_results",
    f"""WITH a1 AS ({_A1_SQL}),
a AS (SELECT metric, mean AS ma, sem AS sa FROM a1 WHERE model = 'A'),
b AS (SELECT metric, mean AS mb, sem AS sb FROM a1 WHERE model = 'R'),
j AS (SELECT * FROM a JOIN b USING (metric))
SELECT metric, ma AS "A", mb AS "R", round((ma - mb) / nullif(mb, 0) * 100, 6) AS diff_pct, round({_Z}, 6) AS z_score,
       round(2.0 * (1.0 - 0.5 * (1.0 + {_erf_sql(f"(abs({_Z}) / CAST('1.4142135623730951' AS DOUBLE))")})), 6) AS p_value
FROM j""",
)
def q_compare(spark, sf):
    a1 = _a1(spark, sf)
    return S.compare_results(a1.where(F.col("model") == "A"), a1.where(F.col("model") == "R"), "A", "R")


_BLOCK_SQL = ("SELECT l_linestatus AS data, l_linenumber AS rep, l_returnflag AS model, avg(l_quantity) AS value "
              "FROM lineitem GROUP BY ALL")


def _block_values(spark, sf):
    return _runs_wide(spark, sf).groupBy("data", "rep", "model").agg(F.avg("l_quantity").alias("value"))


@register(
    "F2_friedman_statistic",
    f"""WITH v AS ({_BLOCK_SQL}),
r AS (SELECT *, rank() OVER (PARTITION BY data, rep ORDER BY value) + (count(*) OVER (PARTITION BY data, rep, value) - 1) / 2.0 AS ar FROM v),
s AS (SELECT model, sum(ar) AS rr FROM r GROUP BY model),
t AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS tt FROM (SELECT count(*) AS c FROM v GROUP BY data, rep, value)),
k AS (SELECT count(DISTINCT model) AS k, count(DISTINCT (data, rep)) AS b FROM v)
SELECT round((12.0 / (b * k * (k + 1)) * (SELECT sum(rr * rr) FROM s) - 3.0 * b * (k + 1)) / (1.0 - tt / (b * k * (k * k - 1))), 6)
       AS statistic, CAST(k - 1 AS INTEGER) AS dof, b AS n_blocks FROM k, t""",
)
def q_friedman(spark, sf):
    return S.friedman_statistic(_block_values(spark, sf), ["data", "rep"], "model", "value")


_WIDE_SQL = ("SELECT data, rep, " + ", ".join(f"max(CASE WHEN model = '{m}' THEN value END) AS \"{m}\"" for m in MODELS)
             + f" FROM ({_BLOCK_SQL}) GROUP BY ALL")


@register(
    "F3_wilcoxon_pairs",
    f"""WITH w AS ({_WIDE_SQL}),
d AS ({' UNION ALL '.join(f"SELECT '{a}' AS model_a, '{b}' AS model_b, \"{a}\" - \"{b}\" AS d FROM w" for a, b in combinations(MODELS, 2))}),
r AS (SELECT *, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(d))
             + (count(*) OVER (PARTITION BY model_a, model_b, abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0)
SELECT model_a, model_b, round(sum(CASE WHEN d > 0 THEN r ELSE 0.0 END), 6) AS w_plus,
       round(sum(CASE WHEN d < 0 THEN r ELSE 0.0 END), 6) AS w_minus, count(*) AS n FROM r GROUP BY ALL""",
)
def q_wilcoxon(spark, sf):
    wide = _runs_wide(spark, sf).groupBy("data", "rep").pivot("model", MODELS).agg(F.avg("l_quantity"))
    return S.wilcoxon_pairs(wide, MODELS)


# three models, so two degrees of freedom, where the tail is exp(-x / 2)
@register(
    "F2_friedman_test",
    f"""WITH v AS ({_BLOCK_SQL}),
r AS (SELECT *, rank() OVER (PARTITION BY data, rep ORDER BY value) + (count(*) OVER (PARTITION BY data, rep, value) - 1) / 2.0 AS ar FROM v),
s AS (SELECT model, sum(ar) AS rr FROM r GROUP BY model),
t AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS tt FROM (SELECT count(*) AS c FROM v GROUP BY data, rep, value)),
k AS (SELECT count(DISTINCT model) AS k, count(DISTINCT (data, rep)) AS b FROM v),
x AS (SELECT (12.0 / (b * k * (k + 1)) * (SELECT sum(rr * rr) FROM s) - 3.0 * b * (k + 1)) / (1.0 - tt / (b * k * (k * k - 1))) AS x FROM k, t)
SELECT round(x, 6) AS statistic, round(least(1.0, exp(-x / 2)), 6) AS p_value FROM x""",
)
def q_friedman_test(spark, sf):
    stat, p = S.friedman_test(_block_values(spark, sf), ["data", "rep"], "model", "value")
    return spark.createDataFrame([(round(stat, 6), round(p, 6))], "statistic double, p_value double")


# at most 14 blocks: all 2^n sign patterns are counted where no difference is tied
@register(
    "F3_pairwise_test",
    f"""WITH w AS ({_WIDE_SQL}),
d AS ({' UNION ALL '.join(f"SELECT '{a}' AS model_a, '{b}' AS model_b, \"{a}\" - \"{b}\" AS d FROM w" for a, b in combinations(MODELS, 2))}),
r AS (SELECT *, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(d))
             + (count(*) OVER (PARTITION BY model_a, model_b, abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0),
s AS (SELECT model_a, model_b, CAST(sum(CASE WHEN d > 0 THEN r ELSE 0.0 END) AS DOUBLE) AS wp,
             CAST(sum(CASE WHEN d < 0 THEN r ELSE 0.0 END) AS DOUBLE) AS wm, count(*) AS n FROM r GROUP BY ALL),
g AS (SELECT model_a, model_b, abs(d) AS ad, CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY ALL),
t AS (SELECT model_a, model_b, sum(c * c * c - c) AS tt FROM g GROUP BY ALL),
m AS (SELECT model_a, model_b, wp, n, unnest(range(CAST(1 AS BIGINT) << n)) AS m FROM s),
e AS (SELECT model_a, model_b, avg(CASE WHEN v <= wp THEN 1.0 ELSE 0.0 END) AS lo, avg(CASE WHEN v >= wp THEN 1.0 ELSE 0.0 END) AS hi
      FROM (SELECT model_a, model_b, wp, list_sum([((m >> i) & 1) * (i + 1) for i in range(n)]) AS v FROM m) GROUP BY ALL),
z AS (SELECT *, (least(wp, wm) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tt / 48.0) AS z
      FROM s JOIN t USING (model_a, model_b) JOIN e USING (model_a, model_b)),
p AS (SELECT model_a, model_b, least(wp, wm) AS statistic,
             least(1.0, CASE WHEN tt = 0 THEN 2 * least(lo, hi) ELSE 1.0 + {_erf_sql("(z / CAST('1.4142135623730951' AS DOUBLE))")} END) AS p FROM z),
h AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, model_a, model_b) + 1) * p AS q FROM p),
c AS (SELECT *, max(least(1.0, q)) OVER (ORDER BY p, model_a, model_b) AS pc FROM h)
SELECT model_a, model_b, statistic, round(p, 9) AS p_value, round(pc, 9) AS p_corrected, pc < 0.1 AS reject FROM c""",
)
def q_pairwise(spark, sf):
    """Signed-rank tests of all model pairs with Holm's correction."""
    wide = _runs_wide(spark, sf).groupBy("data", "rep").pivot("model", MODELS).agg(F.avg("l_quantity"))
    return S.pairwise_test(wide, MODELS)


@register(
    "J7_intersect_metrics",
    f"""WITH a1 AS ({_A1_SQL})
SELECT a.metric, a.mean AS mean_a, a.sem AS sem_a, b.mean AS mean_b, b.sem AS sem_b
FROM (SELECT * FROM a1 WHERE model = 'A') a JOIN (SELECT * FROM a1 WHERE model = 'N' AND metric <> 'l_tax') b USING (metric)""",
)
def q_intersect(spark, sf):
    a1 = _a1(spark, sf)
    a = a1.where(F.col("model") == "A").drop("model")
    b = a1.where((F.col("model") == "N") & (F.col("metric") != "l_tax")).drop("model")
    return J.intersect_metrics(a, b)


GRID_MODELS, GRID_DATA, GRID_REPS = ["A", "N", "R", "X"], ["F", "O"], list(range(1, 9))


@register(
    "J8_missing_runs",
    f"""WITH g AS (SELECT m.model, d.data, CAST(r.rep AS INTEGER) AS rep FROM
  (SELECT unnest({GRID_MODELS}) AS model) m, (SELECT unnest({GRID_DATA}) AS data) d,
  (SELECT unnest({GRID_REPS}) AS rep) r)
SELECT * FROM g WHERE (model, data, rep) NOT IN
  (SELECT (l_returnflag, l_linestatus, l_linenumber) FROM lineitem)""",
)
def q_missing_runs(spark, sf):
    from itertools import product

    grid = spark.createDataFrame(list(product(GRID_MODELS, GRID_DATA, GRID_REPS)), "model string, data string, rep int")
    log_df = _runs_wide(spark, sf).select("model", "data", "rep")
    return J.missing_runs(log_df, grid, ["model", "data", "rep"])


NUM_EXP = 25_000


@register(
    "J9_missing_counts",
    f"""WITH m AS (SELECT unnest({GRID_MODELS}) AS model),
c AS (SELECT l_returnflag AS model, count(*) AS done FROM lineitem GROUP BY ALL)
SELECT model, CAST(greatest(0, {NUM_EXP} - coalesce(done, 0)) AS BIGINT) AS missing FROM m LEFT JOIN c USING (model)""",
)
def q_missing_counts(spark, sf):
    models = spark.createDataFrame([(m,) for m in GRID_MODELS], "model string")
    return J.missing_counts(_runs_wide(spark, sf), models, NUM_EXP)


@register(
    "P4_filter_log",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax "
    "FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag IN ('A', 'R')",
)
def q_filter_log(spark, sf):
    return A.filter_log(_lineitem(spark, sf), {"l_linestatus": "F"}, {"l_returnflag": ["A", "R"]},
                        drop=["l_linestatus", "l_returnflag", "l_shipdate"])


@register(
    "P6_derive_ratio",
    f"SELECT corr_intra, corr_inter, round(corr_inter / nullif(corr_intra, 0), 6) AS ratio FROM "
    f"({SQL['C8_intra_inter_correlation']})",
)
def q_ratio_col(spark, sf):
    c8 = C.intra_inter_correlation(_lineitem(spark, sf), _S0, _S1)
    return A.derive_ratio(c8.select("corr_intra", "corr_inter"), "corr_inter", "corr_intra")


@register("P7_binarize", "SELECT o_orderkey, CAST(o_totalprice <= 150000 AS INTEGER) AS label FROM orders")
def q_binarize(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return A.binarize(o, "o_totalprice", 150000.0, out="label").select("o_orderkey", "label")


@register(
    "S9_read_result_sets",
    f"SELECT metric, " + ", ".join(f"max(CASE WHEN model = '{m}' THEN mean END) AS \"{m}\"" for m in MODELS)
    + f" FROM ({_A1_SQL}) GROUP BY metric",
)
def q_result_sets(spark, sf):
    a1 = _a1(spark, sf)
    return IO.read_result_sets({m: a1.where(F.col("model") == m) for m in MODELS})


@register(
    "W6_stack_rows",
    f"WITH a1 AS ({_A1_SQL}) SELECT * FROM a1 WHERE model = 'A' UNION ALL SELECT * FROM a1 WHERE model = 'N'",
)
def q_stack(spark, sf):
    a1 = _a1(spark, sf)
    return A.stack_rows(a1.where(F.col("model") == "A"), a1.where(F.col("model") == "N"))


@register(
    "W2_moving_average",
    "SELECT o_orderkey AS __row_id, o_orderstatus, o_totalprice, o_custkey, round(avg(CAST(o_custkey AS DOUBLE)) OVER "
    "(PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) "
    "AS moving_avg FROM orders",
)
def q_moving_avg(spark, sf):
    o = orders_with_id(spark, sf).select(ROW_ID, "o_orderstatus", "o_totalprice", "o_custkey")
    return S.moving_average(o, "o_totalprice", "o_custkey", "o_orderstatus", ROW_ID, window=10)


_CSV_SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"


@register(
    "S1_scan_csv",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders "
    "WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL "
    "AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL",
)
def q_scan_csv(spark, sf):
    path = IO.scratch_path(spark, "orders-csv")
    IO.sink_csv(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                   "o_orderpriority"), path)
    return IO.scan_csv(spark, path, schema=_CSV_SCHEMA)


@register("S3_sink_csv", _J2_SQL)
def q_sink_csv(spark, sf):
    path = IO.scratch_path(spark, "j2-csv")
    j2 = J.random_join(orders_parts(spark, sf), SEED)
    IO.sink_csv(j2, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in j2.schema.fields)
    return IO.scan_csv(spark, path, schema=schema)


@register(
    "S4_append_result_log",
    f"WITH a1 AS ({_A1_SQL}) SELECT * FROM a1 WHERE model IN ('A', 'N')",
)
def q_append_log(spark, sf):
    path = IO.scratch_path(spark, "result-log")
    a1 = _a1(spark, sf)
    for m in ("A", "N"):
        IO.append_result_log(a1.where(F.col("model") == m), path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------------------
# generators, manager and harness
# ---------------------------------------------------------------------------

from quiltspark.operators.generators.base import Identity, generate_synthetic_data  # noqa: E402
from quiltspark.operators.generators.bayes_net import BayesNet  # noqa: E402
from quiltspark.plans import harness as H  # noqa: E402
from quiltspark.plans.manager import Concatenating, DisjointSynthesizer, RandomJoining  # noqa: E402

BN_COLS = ["o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey"]
BN_CATEGORICAL = ["o_orderstatus", "o_orderpriority"]


@register("G3_identity_generator", SQL["J1_concatenate"])
def q_identity(spark, sf):
    parts = orders_parts(spark, sf)
    return J.concatenate({k: Identity().generate(p) for k, p in parts.items()})


def _disc_sql():
    cols = []
    for c in BN_COLS:
        if c in BN_CATEGORICAL:
            cols.append(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}")
        else:
            lo, hi = f"(SELECT min(CAST({c} AS DOUBLE)) FROM orders)", f"(SELECT max(CAST({c} AS DOUBLE)) FROM orders)"
            cols.append(f"CAST(least(floor((CAST({c} AS DOUBLE) - {lo}) / (({hi} - {lo}) / 20.0)), 19) AS INTEGER) AS {c}")
    return "SELECT " + ", ".join(cols) + " FROM orders"


_BN_CANDS = [(x, (p,)) for x in BN_COLS for p in BN_COLS if p != x]


@register(
    "G4_mutual_information",
    f"""WITH disc AS ({_disc_sql()}),
j AS ({' UNION ALL '.join(f"SELECT '{x}' AS attribute, '{ps[0]}' AS parent, {x} AS xv, CAST({ps[0]} AS VARCHAR) AS pk, count(*) AS n FROM disc GROUP BY ALL" for x, ps in _BN_CANDS)}),
px AS (SELECT attribute, parent, xv, sum(n) AS nx FROM j GROUP BY ALL),
pp AS (SELECT attribute, parent, pk, sum(n) AS np FROM j GROUP BY ALL),
m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM orders)
SELECT attribute, parent, round(sum((n / m) * ln((n * m) / (nx * np))), 6) AS mi
FROM j JOIN px USING (attribute, parent, xv) JOIN pp USING (attribute, parent, pk), m GROUP BY attribute, parent""",
)
def q_mutual_information(spark, sf):
    o = orders_with_id(spark, sf).select(ROW_ID, *BN_COLS)
    bn = BayesNet()
    bn._m = o.count()
    disc = bn._discretise(o)
    names = spark.createDataFrame([(i, x, ps[0]) for i, (x, ps) in enumerate(_BN_CANDS)], "cid int, attribute string, parent string")
    mi = bn.mutual_information(disc, _BN_CANDS)
    return mi.join(names, "cid").select("attribute", "parent", F.round("mi", 6).alias("mi"))


def _encoded_orders(spark, sf):
    from quiltspark.operators.encode import OrdinalEncoder

    o = orders_with_id(spark, sf).select(ROW_ID, *BN_COLS)
    return OrdinalEncoder(BN_CATEGORICAL).fit(o).transform(o)


@register("G4_bayes_net_sample")
def q_bn_sample(spark, sf):
    """Bayes-net synthesis of encoded orders (rows-only: a fitted model's sample)."""
    return generate_synthetic_data(_encoded_orders(spark, sf), "bayes_net", seed=SEED)


@register("G5_bayes_net_dp_sample")
def q_bn_dp_sample(spark, sf):
    """Noise from a fixed seed, so the query's result can be repeated; a release leaves ``noise_seed`` out."""
    return generate_synthetic_data(_encoded_orders(spark, sf), "bayes_net_dp", seed=SEED, noise_seed=SEED)


@register("G6_cart_sample")
def q_cart_sample(spark, sf):
    return generate_synthetic_data(_encoded_orders(spark, sf), "cart", seed=SEED, categorical=BN_CATEGORICAL)


@register("H2_fit_generate")
def q_fit_generate(spark, sf):
    """End to end: split orders, Bayes net + CART per split (G7 fan-out), random re-join, decode."""
    o = orders_with_id(spark, sf).select(ROW_ID, *BN_COLS)
    ds = DisjointSynthesizer(o, [("bayes_net", ["o_orderstatus", "o_totalprice"]), ("cart", ["o_custkey", "o_orderpriority"])],
                             joining_strategy=RandomJoining(SEED), seed=SEED)
    return ds.fit_generate()


@register(
    "H3_conduct_joining",
    f"""WITH a AS (SELECT o_orderstatus, o_totalprice, {rank_sql(SEED, 'split0', 'o_orderkey')} AS __row_id FROM orders),
     b AS (SELECT o_custkey, o_orderpriority, {rank_sql(SEED, 'split1', 'o_orderkey')} AS __row_id FROM orders)
SELECT * FROM a JOIN b USING (__row_id)""",
)
def q_conduct_joining(spark, sf):
    """Re-join stored parts with another strategy (identity-generated parts, random re-join)."""
    ds = DisjointSynthesizer(orders_with_id(spark, sf), ["debug", "debug"], seed=SEED)
    ds.synthetic_parts = orders_parts(spark, sf)
    ds.strategy = RandomJoining(SEED)
    return ds.conduct_joining()


_SWEEP_TS = [round(0.05 * i, 2) for i in range(21)]


@register(
    "H7_threshold_sweep",
    f"WITH {_ROUND0_SQL} " + " UNION ALL ".join(
        f"SELECT CAST('{t}' AS DOUBLE) AS threshold, CAST(count(*) FILTER (WHERE score >= CAST('{t}' AS DOUBLE)) AS BIGINT) "
        f"AS accepted FROM j0" for t in _SWEEP_TS
    ),
)
def q_sweep(spark, sf):
    cand = J.random_join(orders_parts(spark, sf), SEED, tag=":r0")
    return H.threshold_sweep(SCORER.score(cand), _SWEEP_TS)


# ---------------------------------------------------------------------------
# learned validators on orders parts and model-based metrics
# ---------------------------------------------------------------------------

from quiltspark.operators import metrics as U  # noqa: E402
from quiltspark.operators import validators as V  # noqa: E402

_NUM_SPLITS = {"split0": ["o_totalprice"], "split1": ["o_custkey"]}


def _validated_round(spark, sf, validator):
    parts = orders_parts(spark, sf, _NUM_SPLITS)
    cand = J.random_join(parts, SEED, tag=":r0")
    acc, _ = validator.validate(cand, "auto", AUTO_P)
    return acc.select(J.POS, "__id_split0", "__id_split1", "score")


@register("V2_classifier_validator")
def q_classifier_validator(spark, sf):
    """Random forest (100 trees, depth 5) + isotonic choice, fitted on the training set, one auto round."""
    v = V.ClassifierValidator(seed=SEED).fit(orders_parts(spark, sf, _NUM_SPLITS))
    return _validated_round(spark, sf, v)


@register("V6_density_validator")
def q_density_validator(spark, sf):
    v = V.DensityValidator(seed=SEED).fit(orders_parts(spark, sf, _NUM_SPLITS))
    return _validated_round(spark, sf, v)


@register("V8_isolation_forest_validator")
def q_iforest_validator(spark, sf):
    v = V.IsolationForestValidator(seed=SEED).fit(orders_parts(spark, sf, _NUM_SPLITS))
    return _validated_round(spark, sf, v)


@register("V12_sample_space_projection")
def q_projection(spark, sf):
    parts = orders_parts(spark, sf, _NUM_SPLITS)
    train = M.setup_training_data(parts, 1, seed=SEED)
    holdout = M.setup_training_data(parts, 1, seed=SEED + 1)
    return V.sample_space_projection(SCORER_NUM, train, holdout)


SCORER_NUM = LinearScoreValidator({"o_totalprice": 1e-05, "o_custkey": -0.002}, bias=0.0, digits=9)


def _assoc_sql(d: str) -> dict:
    """SQL scalar subqueries of the mixed association entries over relation ``d``."""
    def eta(cat, num):
        return (f"(SELECT sqrt(greatest(0.0, sum(ng * (mg - mu) * (mg - mu)) / nullif((SELECT var_pop(CAST({num} AS DOUBLE)) "
                f"* count(*) FROM {d}), 0))) FROM (SELECT count(*) AS ng, avg(CAST({num} AS DOUBLE)) AS mg FROM {d} GROUP BY {cat}), "
                f"(SELECT avg(CAST({num} AS DOUBLE)) AS mu FROM {d}))")

    cram = (f"(SELECT sqrt(greatest(0.0, (n * (s - 1.0)) / n / (least(ka, kb) - 1))) FROM "
            f"(SELECT sum(o * o / (ra * cb)) AS s, sum(o) AS n FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS o FROM {d} GROUP BY ALL) c "
            f"JOIN (SELECT o_orderstatus, count(*) AS ra FROM {d} GROUP BY ALL) USING (o_orderstatus) "
            f"JOIN (SELECT o_orderpriority, count(*) AS cb FROM {d} GROUP BY ALL) USING (o_orderpriority)), "
            f"(SELECT count(DISTINCT o_orderstatus) AS ka, count(DISTINCT o_orderpriority) AS kb FROM {d}))")
    pear = (f"(SELECT coalesce(covar_pop(CAST(o_totalprice AS DOUBLE), CAST(o_custkey AS DOUBLE)) / nullif(stddev_pop(CAST(o_totalprice AS DOUBLE)) "
            f"* stddev_pop(CAST(o_custkey AS DOUBLE)), 0), 0.0) FROM {d})")
    return {"cc": cram, "e1": eta("o_orderstatus", "o_totalprice"), "e2": eta("o_orderstatus", "o_custkey"),
            "e3": eta("o_orderpriority", "o_totalprice"), "e4": eta("o_orderpriority", "o_custkey"), "pp": pear}


_RA, _SY = _assoc_sql("ra"), _assoc_sql("sy")


@register(
    "U2_corr_diff",
    f"""WITH {_HALVES_SQL}, ra AS (SELECT * FROM halves WHERE data = 'Real'), sy AS (SELECT * FROM halves WHERE data = 'Synthetic')
SELECT round(sqrt(2 * ({' + '.join(f'power({_RA[k]} - {_SY[k]}, 2)' for k in _RA)})), 6) AS corr_mat_diff""",
)
def q_corr_diff(spark, sf):
    real, syn = _halves(spark, sf)
    v = U.corr_diff(real, syn, ["o_orderstatus", "o_orderpriority"], ["o_totalprice", "o_custkey"])
    return spark.createDataFrame([(round(v, 6),)], "corr_mat_diff double")


@register("U3_pca_difference")
def q_pca(spark, sf):
    real, syn = _halves(spark, sf)
    r = U.pca_difference(real, syn, ["o_totalprice", "o_custkey"])
    return spark.createDataFrame([(k, float(v)) for k, v in r.items()], "metric string, value double")


@register("U6_U7_classifier_utility")
def q_classifier_utility(spark, sf):
    """Macro F1 and AUROC differences (synthetic-trained minus real-trained) on the holdout half."""
    real, holdout = _halves(spark, sf)
    lab = lambda df: df.withColumn("label", (F.col("o_orderstatus") == "F").cast("double"))
    # synthetic stand-in: the real half with its column splits randomly re-paired
    syn = RandomJoining(SEED).join({"a": real.select(ROW_ID, "o_orderstatus", "o_totalprice"),
                                    "b": real.select(ROW_ID, "o_custkey")})
    r = U.classifier_utility(lab(real), lab(syn), lab(holdout), ["o_totalprice", "o_custkey"], "label", seed=SEED)
    return spark.createDataFrame([(k, float(v)) for k, v in r.items()], "metric string, value double")


@register("U8_membership_inference")
def q_mia(spark, sf):
    """MIA recall / precision of a random re-join of the real half, against the holdout half."""
    real, holdout = _halves(spark, sf)
    syn = RandomJoining(SEED).join({"a": real.select(ROW_ID, "o_totalprice"), "b": real.select(ROW_ID, "o_custkey")})
    r = U.membership_inference(real, syn, holdout, ["o_totalprice", "o_custkey"], seed=SEED)
    return spark.createDataFrame([(k, float(v)) for k, v in r.items()], "metric string, value double")


# customers re-joined from two column splits, next to the real ones; all pairs in SQL
_NEAR_SQL = f"""
real AS (SELECT c_custkey AS id, c_acctbal, c_nationkey, c_mktsegment FROM customer),
a AS (SELECT c_acctbal, c_nationkey, {rank_sql(SEED, 'a', 'c_custkey')} AS __pos FROM customer),
b AS (SELECT c_mktsegment, {rank_sql(SEED, 'b', 'c_custkey')} AS __pos FROM customer),
syn AS (SELECT * FROM a JOIN b USING (__pos)),
span AS (SELECT max(c_acctbal) - min(c_acctbal) AS s FROM customer)
"""
NEAR_NUMERIC, NEAR_CATEGORICAL = ["c_acctbal"], ["c_nationkey", "c_mktsegment"]


def _near_sql(weights: str) -> str:
    """Per synthetic row the nearest real distance, per real row the nearest other and the nearest synthetic one."""
    far = "abs(x.c_acctbal - y.c_acctbal) / s * w1 + (x.c_nationkey <> y.c_nationkey)::INT * w2 + (x.c_mktsegment <> y.c_mktsegment)::INT * w3"
    return f"""WITH {_NEAR_SQL}, w AS ({weights}),
to_real AS (SELECT min({far}) AS d FROM syn x, real y, span, w GROUP BY x.__pos),
own AS (SELECT x.id, min({far}) AS d FROM real x, real y, span, w WHERE x.id <> y.id GROUP BY x.id),
to_syn AS (SELECT x.id, min({far}) AS d FROM real x, syn y, span, w GROUP BY x.id)
"""


def _customers(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", ROW_ID)
    real = c.select(ROW_ID, *NEAR_NUMERIC, *NEAR_CATEGORICAL)
    syn = J.random_join({"a": c.select(ROW_ID, "c_acctbal", "c_nationkey"), "b": c.select(ROW_ID, "c_mktsegment")}, SEED)
    return real, syn


@register(
    "U4_dcr",
    _near_sql("SELECT 1.0::DOUBLE AS w1, 1.0::DOUBLE AS w2, 1.0::DOUBLE AS w3")
    + """SELECT round(s.m, 9) AS median_synthetic, round(r.m, 9) AS median_real, round(s.m / r.m, 6) AS median_dcr
FROM (SELECT median(d) AS m FROM to_real) s, (SELECT median(d) AS m FROM own) r""",
)
def q_dcr(spark, sf):
    """Distance to the closest record of a random re-join of all customers."""
    r = P.median_dcr(*_customers(spark, sf), NEAR_NUMERIC, NEAR_CATEGORICAL)
    out = spark.createDataFrame([tuple(r.values())], "median_synthetic double, median_real double, median_dcr double")
    return out.select(F.round("median_synthetic", 9).alias("median_synthetic"), F.round("median_real", 9).alias("median_real"),
                      F.round("median_dcr", 6).alias("median_dcr"))


def _entropy_sql(column: str) -> str:
    return f"(SELECT 1.0 / (ln(sum(n)) - sum(n * ln(n)) / sum(n)) FROM (SELECT count(*)::DOUBLE AS n FROM customer GROUP BY {column}))"


@register(
    "U5_eps_risk",
    _near_sql(f"SELECT {_entropy_sql('c_acctbal')} AS w1, {_entropy_sql('c_nationkey')} AS w2, {_entropy_sql('c_mktsegment')} AS w3")
    + """SELECT round(avg((round(t.d, 9) < round(o.d, 9))::INT), 9) AS eps_identif_risk, count(*) AS rows, round(max(o.d), 6) AS farthest
FROM own o JOIN to_syn t USING (id)""",
)
def q_eps_risk(spark, sf):
    """Identifiability risk of a random re-join of all customers."""
    rows = P.identifiability(*_customers(spark, sf), NEAR_NUMERIC, NEAR_CATEGORICAL)
    risk = F.sum(F.when(F.col("at_risk"), F.col("n")).otherwise(0)) / F.sum("n")
    return rows.agg(F.round(risk, 9).alias("eps_identif_risk"), F.sum("n").alias("rows"), F.round(F.max("own"), 6).alias("farthest"))


@register("V10_knn_backend")
def q_knn(spark, sf):
    """Scores of a random re-join of orders by a k-NN validator trained on the true joins."""
    parts = {n: p.drop("o_orderstatus", "o_orderpriority") for n, p in orders_parts(spark, sf).items()}
    v = V.ClassifierValidator(V.classifier_backend("knn"), calibration=None, seed=SEED).fit(parts)
    return v.score(J.random_join(parts, SEED)).select(J.POS, "o_totalprice", "o_custkey", "score")


@register("U9_evaluate")
def q_evaluate(spark, sf):
    """Metric table of one synthetic table with all of U1-U8."""
    real, holdout = _halves(spark, sf)
    real = real.withColumn("label", (F.col("o_orderstatus") == "F").cast("double"))
    holdout = holdout.withColumn("label", (F.col("o_orderstatus") == "F").cast("double"))
    syn = RandomJoining(SEED).join({"a": real.select(ROW_ID, "o_orderstatus", "label", "o_totalprice"),
                                    "b": real.select(ROW_ID, "o_custkey", "o_orderpriority")})
    return U.evaluate(real, syn, holdout, ["o_orderstatus", "o_orderpriority"], ["o_totalprice", "o_custkey"],
                      label="label", seed=SEED, mia_rounds=5)


def _h_eval(real):
    """Evaluation used by the harness queries: Hellinger average of a synthetic table."""
    def run(syn):
        h = U.hellinger(real, syn, ["o_orderstatus", "o_orderpriority"], ["o_totalprice"])
        return {"avg_h_dist": h.where(F.col("column") == "avg_h_dist").first()["h_dist"]}
    return run


def _h_parts(real):
    return {"split0": real.select(ROW_ID, "o_orderstatus", "o_totalprice"),
            "split1": real.select(ROW_ID, "o_custkey", "o_orderpriority")}


@register("H5_H6_repeated_experiment")
def q_repeated(spark, sf):
    """Three seeded random re-joins of the table, each evaluated; mean / sem per metric plus time."""
    real = orders_with_id(spark, sf)
    parts = _h_parts(real)
    gen = lambda df, rep: RandomJoining(SEED + rep).join(parts)
    return H.repeated_experiment(spark, real, gen, _h_eval(real), num_reps=3, timed=True)


@register("H8_validator_comparison")
def q_validator_comparison(spark, sf):
    """Same parts, concatenation baseline vs. a validated join with the fixed scorer."""
    real = orders_with_id(spark, sf)
    rows = H.validator_comparison(
        _h_parts(real), {"linear": SCORER}, lambda v: J.ValidatedJoin(v, behaviour="adaptive", seed=SEED), _h_eval(real), baseline=Concatenating())
    return spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "validator string, metric string, value double")


@register("H8_many_validators")
def q_many_validators(spark, sf):
    """Three validators with the limits of their own preset, joined at once, next to the baseline."""
    real = orders_with_id(spark, sf)
    validators = {
        "linear": SCORER,
        "opposite": LinearScoreValidator({"o_totalprice": -1e-05, "o_custkey": 0.002}),
        "steep": LinearScoreValidator({"o_totalprice": 4e-05, "o_custkey": -0.001}),
    }
    rows = H.validator_comparison(
        _h_parts(real), validators, lambda v: J.ValidatedJoin(v, behaviour="standard", seed=SEED), _h_eval(real), baseline=Concatenating())
    return spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "validator string, metric string, value double")


@register("H9_run_grid")
def q_run_grid(spark, sf):
    """Resumable grid over seeds and strategies: a second call finds nothing missing."""
    real = orders_with_id(spark, sf)
    parts = _h_parts(real)
    path = IO.scratch_path(spark, "run-grid-log")

    def run(p):
        joined = RandomJoining(int(p["seed"])).join(parts) if p["joining"] == "random" else J.concatenate(parts)
        return _h_eval(real)(joined)

    axes = {"joining": ["random", "concat"], "seed": [1, 2]}
    H.run_grid(spark, path, axes, run)
    if H.run_grid(spark, path, axes, run) != 0:
        raise RuntimeError("resumed grid re-ran logged runs")
    return spark.read.parquet(path)


@register(
    "M6_holdout_split",
    f"""WITH t AS ({_M3_SQL}),
r AS (SELECT j, label, row_number() OVER (PARTITION BY label ORDER BY
        CAST(('0x' || substr(md5('{SEED}:holdout:' || CAST(label AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 15)) AS BIGINT), j) AS rn,
        count(*) OVER (PARTITION BY label) AS nc FROM t)
SELECT j, label, CASE WHEN rn <= (nc + 4) // 5 THEN 'test' ELSE 'train' END AS part FROM r""",
)
def q_holdout(spark, sf):
    train, test = M.holdout_split(_training(spark, sf).select("j", "label"), 5, SEED)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@register(
    "P2_restore_column_order",
    f"SELECT __pos AS __row_id, o_orderstatus, o_custkey, o_totalprice, o_orderpriority FROM ({_J2_SQL})",
)
def q_restore_order(spark, sf):
    from quiltspark.operators.encode import restore_column_order

    j2 = J.random_join(orders_parts(spark, sf), SEED).withColumnRenamed(J.POS, ROW_ID)
    return restore_column_order(j2, [ROW_ID, "o_orderstatus", "o_custkey", "o_totalprice", "o_orderpriority"])


@register("E4_scale_features")
def q_scale(spark, sf):
    """MinMax, standard and robust scaling of the assembled orders features, plus the 250-quantile transform."""
    from pyspark.ml.functions import vector_to_array

    from quiltspark.operators.encode import quantile_transform, scaler

    o = orders_with_id(spark, sf).select(ROW_ID, "o_totalprice", "o_custkey")
    x = V.assemble(["o_totalprice", "o_custkey"], "features").transform(o)
    for kind in ("minmax", "standard", "robust"):
        x = scaler(kind, "features", f"s_{kind}").fit(x).transform(x)
        x = x.withColumn(f"s_{kind}", vector_to_array(f"s_{kind}"))
    q = quantile_transform(o, ["o_totalprice", "o_custkey"]).select(
        ROW_ID, F.col("o_totalprice").alias("q_totalprice"), F.col("o_custkey").alias("q_custkey"))
    return x.drop("features").join(q, ROW_ID)


@register("S8_save_load_validator")
def q_save_load(spark, sf):
    """Fit a classifier validator, save it to the shared folder, load it back and score candidates."""
    from pyspark.ml.classification import RandomForestClassifier

    parts = orders_parts(spark, sf, _NUM_SPLITS)
    v = V.ClassifierValidator(RandomForestClassifier(numTrees=10, maxDepth=4, seed=SEED), calibration=None,
                              seed=SEED).fit(parts)
    path = IO.scratch_path(spark, "validator")
    v.save(path)
    loaded = V.ClassifierValidator.load(path)
    return loaded.score(J.random_join(parts, SEED)).select(J.POS, "__id_split0", "__id_split1", "score")
