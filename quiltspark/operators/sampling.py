"""Sampling and shuffling operators (M1-M8, S7), all exact and seed-deterministic.

Every draw is a function of (seed, tag, index) through an md5 key, so results
do not depend on partitioning and have DuckDB oracles.  Row counts are exact:
``df.sample`` is Bernoulli and only approximately sized, so it is not used.
Tables are expected to carry a dense ``__row_id`` (0..n-1); see
:func:`quiltspark.operators.positions.with_dense_id` for tables that lack one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltspark.functions.keys import key_to_long, seeded_key
from quiltspark.operators.positions import dense_position, kth_value
from quiltspark.session import materialize

ROW_ID = "__row_id"


def shuffle_rows(df: DataFrame, seed: int, tag: str = "shuffle", out: str = "__pos", n_rows=None) -> DataFrame:
    """M1: full permutation; ``out`` is the row's new 0-based position."""
    return dense_position(df, seeded_key(seed, tag, ROW_ID), ROW_ID, out=out, n_rows=n_rows)


def draw_indices(source_ids: DataFrame, k: int, n: int, seed: int, tag: str) -> DataFrame:
    """``(j, draw)`` for j in 0..k*n-1: draw = uniform index in 0..n-1 with replacement.

    ``source_ids`` holds the dense ``__row_id`` column of the table, so the
    index list is derived from (and grows with) the data itself.
    """
    t = source_ids.select(F.col(ROW_ID), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("__t"))
    j = t.select((F.col(ROW_ID) * F.lit(k) + F.col("__t")).alias("j"))
    return j.select("j", (key_to_long(seeded_key(seed, tag, "j")) % F.lit(n)).alias("__draw"))


def bootstrap_exact(df: DataFrame, k: int, seed: int, tag: str = "boot", n: int | None = None) -> DataFrame:
    """M2: exactly ``k*n`` rows drawn with replacement; ``j`` is the new dense id."""
    n = n if n is not None else df.count()
    draws = draw_indices(df.select(ROW_ID), k, n, seed, tag)
    return draws.join(df, draws["__draw"] == df[ROW_ID]).drop("__draw", ROW_ID)


def setup_training_data(
    parts: Mapping[str, DataFrame],
    num_batches_of_bad_joins: int = 2,
    seed: int = 0,
    negative_class: int = 0,
    n: int | None = None,
) -> DataFrame:
    """M3: labelled join-training set.

    Positives: one shared draw for all parts, so each row is a true row.
    Negatives: an independent draw per part, so rows are random recombinations.
    ``k*n`` rows of each; columns ``j, label, <features of all parts>``.  Parts of
    unequal length have no true rows to draw and raise a ValueError (checked
    unless ``n``, the length of all of them, is given).
    """
    names = list(parts)
    first = parts[names[0]]
    if n is None:
        sizes = {name: p.count() for name, p in parts.items()}
        if len(set(sizes.values())) > 1:
            raise ValueError(f"parts differ in length: {sizes}")
        n = sizes[names[0]]
    k = num_batches_of_bad_joins
    ids = first.select(ROW_ID)

    pos_draw = draw_indices(ids, k, n, seed, "pos")
    true_rows = _concat_on_id(parts)
    positives = pos_draw.join(true_rows, pos_draw["__draw"] == true_rows[ROW_ID]).drop("__draw", ROW_ID)

    negatives = None
    for name in names:
        d = draw_indices(ids, k, n, seed, f"neg:{name}")
        piece = d.join(parts[name], d["__draw"] == parts[name][ROW_ID]).drop("__draw", ROW_ID)
        negatives = piece if negatives is None else negatives.join(piece, "j")
    feats = [c for c in positives.columns if c != "j"]
    return positives.select("j", F.lit(1).alias("label"), *feats).unionByName(
        negatives.select("j", F.lit(negative_class).alias("label"), *feats)
    )


def _concat_on_id(parts: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for p in parts.values():
        out = p if out is None else out.join(p, ROW_ID)
    return out


def _smallest(df: DataFrame, m: int, seed: int, tag: str, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The ``m`` rows with the smallest seeded key (ties broken by id), and all others where the
    key alone tells them apart (None where rows tie at the boundary)."""
    keyed = df.withColumn("__h", key_to_long(seeded_key(seed, tag, id_col)))
    thr = kth_value(keyed, "__h", m - 1)
    # 60-bit keys: a tie at the boundary is astronomically unlikely, but be exact anyway
    c = keyed.agg(F.sum((F.col("__h") < F.lit(thr)).cast("long")).alias("below"),
                  F.sum((F.col("__h") == F.lit(thr)).cast("long")).alias("at")).first()
    n_below, n_at = int(c["below"] or 0), int(c["at"] or 0)
    if n_below + n_at == m:
        near = F.col("__h") <= F.lit(thr)
        return keyed.where(near).drop("__h"), keyed.where(~F.coalesce(near, F.lit(False))).drop("__h")
    below = keyed.where(F.col("__h") < F.lit(thr))
    at_kept = keyed.where(F.col("__h") == F.lit(thr)).orderBy(id_col).limit(m - n_below)  # tied rows only
    return below.unionByName(at_kept).drop("__h"), None


def smallest_by_key(df: DataFrame, m: int, seed: int, tag: str, id_col: str) -> DataFrame:
    """Keep exactly the ``m`` rows with the smallest seeded key (ties broken by id)."""
    return df.limit(0) if m <= 0 else _smallest(df, m, seed, tag, id_col)[0]


def subsample_negatives(training: DataFrame, seed: int, negative_class: int = 0, fraction_div: int = 6) -> DataFrame:
    """M4: keep ``count(negatives) // 6`` negatives (smallest seeded key), all positives."""
    neg = training.where(F.col("label") == negative_class)
    m = neg.count() // fraction_div
    kept = smallest_by_key(neg, m, seed, "subneg", "j")
    return training.where(F.col("label") != negative_class).unionByName(kept)


def kfold_assign(df: DataFrame, k: int, seed: int, id_col: str = ROW_ID, n: int | None = None) -> DataFrame:
    """M5: shuffled k folds of contiguous chunks (first ``n % k`` folds one larger)."""
    n = n if n is not None else df.count()
    q, r = divmod(n, k)
    ranked = dense_position(df, seeded_key(seed, "fold", id_col), id_col, out="__fpos", n_rows=n)
    big = F.lit(r * (q + 1))
    fold = F.when(F.col("__fpos") < big, F.floor(F.col("__fpos") / F.lit(q + 1))).otherwise(
        F.lit(r) + F.floor((F.col("__fpos") - big) / F.lit(max(q, 1)))
    )
    return ranked.withColumn("fold", fold.cast("int")).drop("__fpos")


def train_test_split(df: DataFrame, train_fraction: float, seed: int = 42, id_col: str = ROW_ID, n=None):
    """Exact split; the ``round(frac*n)`` rows with the smallest key are train.

    Returns ``(train, test)``; the test set is the complement (W7) by id: rows of one id share
    their key, so it is what lies above the last key, unless rows tie there.
    """
    n = n if n is not None else df.count()
    m = int(round(train_fraction * n))
    train, test = (df.limit(0), None) if m <= 0 else _smallest(df, m, seed, "split", id_col)
    return train, df.join(train.select(id_col), id_col, "left_anti") if test is None else test


def holdout_split(training: DataFrame, k: int, seed: int, label_col: str = "label", id_col: str = "j"):
    """M6: per class, ``ceil(n_c / k)`` rows to the test side (sklearn ``test_size=1/k``).

    The rows are worked out once and written: classes, sizes, order statistics and both sides read them."""
    trains, tests = [], []
    training = materialize(training, "training")
    classes = [r[0] for r in training.select(label_col).distinct().collect()]  # class labels: tiny
    for c in sorted(classes):
        part = training.where(F.col(label_col) == c)
        n_c = part.count()
        n_test = -(-n_c // k)
        test = smallest_by_key(part, n_test, seed, f"holdout:{c}", id_col)
        trains.append(part.join(test.select(id_col), id_col, "left_anti"))
        tests.append(test)
    union = lambda xs: xs[0] if len(xs) == 1 else xs[0].unionByName(union(xs[1:]))
    return union(trains), union(tests)


def top_up_samples(generated: DataFrame, n: int, seed: int, tag: str = "topup") -> DataFrame:
    """M7: bring a generator's output (dense ``__row_id``) to exactly ``n`` rows.

    Missing rows are resampled with replacement from what was generated;
    surplus rows are cut by id (M8).
    """
    m = generated.count()
    if m == 0:
        raise ValueError("generator returned no rows; nothing to resample")
    if m >= n:
        return head_n(generated, n)
    short = n - m
    # ids m..n-1 are derived from the generated ids: id + m*t for t = 1.. covers the shortfall
    reps = -(-short // m)
    extra_ids = (
        generated.select(F.col(ROW_ID), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("__t"))
        .select((F.col(ROW_ID) + F.lit(m) * F.col("__t")).alias("j"))
        .where(F.col("j") < F.lit(n))
    )
    draws = extra_ids.select("j", (key_to_long(seeded_key(seed, tag, "j")) % F.lit(m)).alias("__draw"))
    extra = draws.join(generated, draws["__draw"] == generated[ROW_ID]).drop("__draw", ROW_ID)
    extra = extra.withColumnRenamed("j", ROW_ID)
    return generated.unionByName(extra.select(*generated.columns))


def head_n(df: DataFrame, n: int, id_col: str = ROW_ID) -> DataFrame:
    """M8: the first ``n`` rows by dense id -- deterministic, unlike ``limit``."""
    return df.where(F.col(id_col) < F.lit(n))
