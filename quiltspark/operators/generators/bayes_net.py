"""Bayesian-network synthesiser (correlated attribute mode), optionally
differentially private.

Fit, all as Spark jobs:
1. Discretise: columns with <= ``categorical_threshold`` distinct values are
   categories; the rest fall into ``histogram_size`` equal-width bins.
2. Structure: greedy, ``k`` parents.  The rows are first counted into a sparse
   cube, one row per combination of codes that occurs, and read no more.  Every
   step scores the candidate (attribute, parent set) pairs that no earlier step
   has scored, in *one* pass over the cube: a grouped sum gives the joint tables
   (map-side combined: at most bins^(k+1) cells per candidate leave a task) and
   the mutual information per candidate is a further grouped aggregate.  Only
   the per-candidate scores (a few thousand numbers) reach the driver.
3. Conditionals: counts per (parents, attribute), optionally with seeded
   Laplace noise over the full cell grid, turned into cumulative arrays per
   parent key -- a table of at most bins^k rows, broadcast when sampling.

Sampling draws one md5 uniform per (row, attribute) and looks the value up in
the cumulative array of its parent key (higher-order array functions, JVM
side).  Parent combinations never seen in training fall back to the
attribute's marginal.
"""

from __future__ import annotations

import math
import secrets
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltspark.functions.keys import seeded_key, uniform01
from quiltspark.operators.generators.base import ROW_ID, Generator, complete_rows, row_index
from quiltspark.session import materialize, spread


def _q(c: str):
    return F.col(f"`{c}`")


class BayesNet(Generator):
    name = "bayes_net"

    def __init__(self, k: int = 2, categorical_threshold: int = 10, histogram_size: int = 20, epsilon: float = 0.0,
                 seed: int = 0, noise_seed: int | None = None):
        self.k = k
        # noise must not follow from a public seed; a test may ask for a fixed one
        self.noise_seed = secrets.randbits(62) if noise_seed is None else noise_seed
        self.categorical_threshold = categorical_threshold
        self.histogram_size = histogram_size
        self.epsilon = epsilon
        self.seed = seed

    # -- discretisation -----------------------------------------------------
    def _discretise(self, train: DataFrame) -> DataFrame:
        cols = [c for c in train.columns if c != ROW_ID]
        self.columns = cols
        self.types = {f.name: f.dataType for f in train.schema.fields}
        distinct = train.agg(*[F.approx_count_distinct(_q(c)).alias(f"d{i}") for i, c in enumerate(cols)]).first()
        self.categories: dict[str, list] = {}
        self.bins: dict[str, tuple[float, float]] = {}
        exprs = []
        for i, c in enumerate(cols):
            if distinct[f"d{i}"] <= self.categorical_threshold + 2:
                vals = [r[0] for r in train.select(_q(c)).distinct().limit(self.categorical_threshold + 1).collect()]
                if len(vals) <= self.categorical_threshold:
                    vals = sorted(v for v in vals if v is not None)
                    self.categories[c] = vals
                    code = F.lit(None).cast("int")
                    for j, v in enumerate(vals):
                        code = F.when(_q(c) == F.lit(v), F.lit(j)).otherwise(code)
                    exprs.append(code.alias(c))
                    continue
            exprs.append(None)
        numeric = [c for c in cols if c not in self.categories]
        if numeric:
            r = train.agg(*[F.min(_q(c)).cast("double").alias(f"lo{i}") for i, c in enumerate(numeric)],
                          *[F.max(_q(c)).cast("double").alias(f"hi{i}") for i, c in enumerate(numeric)]).first()
            for i, c in enumerate(numeric):
                self.bins[c] = (r[f"lo{i}"], r[f"hi{i}"])
        b = self.histogram_size
        out = []
        for c, e in zip(cols, exprs):
            if e is not None:
                out.append(e)
            else:
                lo, hi = self.bins[c]
                w = (hi - lo) / b if hi > lo else 1.0
                out.append(F.least(F.floor((_q(c).cast("double") - F.lit(lo)) / F.lit(w)), F.lit(b - 1)).cast("int").alias(c))
        return train.select(ROW_ID, *out)

    def cardinality(self, c: str) -> int:
        return len(self.categories[c]) if c in self.categories else self.histogram_size

    # -- structure ----------------------------------------------------------
    def cube(self, disc: DataFrame) -> DataFrame:
        """The combinations of all codes that occur, with ``__n`` rows each: what structure and
        conditionals are counted from, so a row of the table is read once."""
        return disc.groupBy(*[_q(c) for c in disc.columns if c != ROW_ID]).agg(F.count(F.lit(1)).alias("__n"))

    def mutual_information(self, disc: DataFrame, candidates: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
        """``(cid, mi)`` for every candidate (attribute, parents) in one pass over the cube
        (of discretised rows, the cube is made first)."""
        m = F.lit(float(self._m))
        cube = disc if "__n" in disc.columns else self.cube(disc)
        recs = F.array(*[
            F.struct(F.lit(cid).alias("cid"), _q(x).alias("xv"),
                     F.concat_ws("|", *[_q(p).cast("string") for p in ps]).alias("pk"), F.col("__n").alias("w"))
            for cid, (x, ps) in enumerate(candidates)
        ])
        joint = cube.select(F.inline(recs)).groupBy("cid", "xv", "pk").agg(F.sum("w").alias("n"))
        px = joint.groupBy("cid", "xv").agg(F.sum("n").alias("nx"))
        pp = joint.groupBy("cid", "pk").agg(F.sum("n").alias("np"))
        j = joint.join(px, ["cid", "xv"]).join(pp, ["cid", "pk"])
        return j.groupBy("cid").agg(
            F.sum((F.col("n") / m) * F.log((F.col("n") * m) / (F.col("nx") * F.col("np")))).alias("mi")
        )

    def _learn_structure(self, cube: DataFrame) -> list[tuple[str, tuple[str, ...]]]:
        rng = np.random.default_rng(self.noise_seed if self.epsilon > 0 else self.seed)
        cols = list(self.columns)
        root = cols[int(rng.integers(len(cols)))]
        network: list[tuple[str, tuple[str, ...]]] = [(root, ())]
        visited = [root]
        steps = max(1, len(cols) - 1)
        eps_step = (self.epsilon / 2.0) / steps if self.epsilon > 0 else 0.0
        known: dict[tuple[str, tuple[str, ...]], float] = {}  # scores don't change from step to step
        while len(visited) < len(cols):
            kk = min(self.k, len(visited))
            cands = [(x, ps) for x in cols if x not in visited for ps in combinations(visited, kk)]
            new = [c for c in cands if c not in known]
            if new:
                scores = {r["cid"]: r["mi"] for r in self.mutual_information(cube, new).collect()}  # <= #candidates
                known.update((c, scores.get(i, 0.0) or 0.0) for i, c in enumerate(new))
            mi = np.array([known[c] for c in cands])
            if eps_step > 0:
                n = self._m
                sens = (2.0 / n) * math.log((n + 1) / 2.0) + ((n - 1) / n) * math.log((n + 1) / max(n - 1, 1))
                gumbel = -np.log(-np.log(rng.uniform(1e-12, 1.0, size=len(cands))))
                best = int(np.argmax(eps_step * mi / (2.0 * sens) + gumbel))
            else:
                best = int(np.argmax(mi))  # first maximum wins
            x, ps = cands[best]
            network.append((x, tuple(ps)))
            visited.append(x)
        return network

    def count_noise_scale(self) -> float:
        """Laplace scale of a released count.  Released are two tables per column, a
        conditional and a marginal, that share half of epsilon; one changed row moves
        a table's counts by 2 in all.  (The other half goes to the structure.)"""
        return 2.0 * (2 * len(self.columns)) / (self.epsilon / 2.0)

    # -- conditionals -------------------------------------------------------
    def _conditional(self, disc: DataFrame, x: str, parents: tuple[str, ...], salt: int) -> DataFrame:
        """``(pk, vals, cum)``: cumulative distribution of ``x`` per parent key."""
        counts = disc.groupBy(*[_q(p) for p in parents], _q(x)).agg(F.sum("__n").cast("double").alias("n"))
        if self.epsilon > 0:
            dims = list(parents) + [x]
            grid = disc.sparkSession.range(1).select(
                *[F.explode(F.sequence(F.lit(0), F.lit(self.cardinality(d) - 1))).alias(d) for d in dims[:1]]
            )
            for d in dims[1:]:  # parameter-sized grid (<= bins^(k+1) cells), built by explode
                grid = grid.withColumn(d, F.explode(F.sequence(F.lit(0), F.lit(self.cardinality(d) - 1))))
            counts = grid.join(counts, dims, "left").fillna(0.0, ["n"])
            scale = self.count_noise_scale()
            cell = F.concat_ws("|", F.lit(x), *[F.col(d).cast("string") for d in dims])
            u = uniform01(seeded_key(self.noise_seed + salt, "dp", cell)) - F.lit(0.5)
            lap = -F.lit(scale) * F.signum(u) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(u))
            counts = counts.withColumn("n", F.greatest(F.col("n") + lap, F.lit(0.0)))
        pk = F.concat_ws("|", *[_q(p).cast("string") for p in parents]) if parents else F.lit("")
        per = counts.groupBy(pk.alias("pk")).agg(
            F.array_sort(F.collect_list(F.struct(_q(x).alias("v"), F.col("n").alias("n")))).alias("cells"),
            F.sum("n").alias("tot"),
        )
        k = self.cardinality(x)
        uniform = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: i.cast("double") / F.lit(float(k)))
        cum = F.transform(
            F.sequence(F.lit(1), F.size("cells")),
            lambda i: F.aggregate(F.slice("cells", 1, i), F.lit(0.0), lambda acc, c: acc + c["n"]) / F.col("tot"),
        )
        return per.select(
            "pk",
            F.when(F.col("tot") > 0, F.transform("cells", lambda c: c["v"])).otherwise(
                F.sequence(F.lit(0), F.lit(k - 1))).alias("vals"),
            F.when(F.col("tot") > 0, cum).otherwise(uniform).alias("cum"),
        )

    def fit(self, train: DataFrame) -> "BayesNet":
        train = spread(complete_rows(train), ROW_ID)
        self._train_ids = train.select(ROW_ID)
        self._m = train.count()
        disc = materialize(self.cube(self._discretise(train)), "bn-cube")
        self.network = self._learn_structure(disc)
        self.conditionals = {}
        self.marginals = {}
        for i, (x, ps) in enumerate(self.network):
            self.conditionals[x] = materialize(self._conditional(disc, x, ps, salt=i), f"bn-cond-{i}")
            marg = self._conditional(disc, x, (), salt=100 + i).first()  # one row, <= bins values
            self.marginals[x] = (list(marg["vals"]), list(marg["cum"]))
        return self

    # -- sampling -----------------------------------------------------------
    def sample(self, n: int, seed: int = 0) -> DataFrame:
        rows = row_index(self._train_ids, self._m, n)
        for x, ps in self.network:
            u = uniform01(seeded_key(seed, f"bn:{x}", ROW_ID))
            pk = F.concat_ws("|", *[F.col(p).cast("string") for p in ps]) if ps else F.lit("")
            cond = F.broadcast(self.conditionals[x])  # <= bins^k keys: bounded by construction
            mv, mc = self.marginals[x]
            mvals = F.array(*[F.lit(v) for v in mv])
            mcum = F.array(*[F.lit(float(c)) for c in mc])
            rows = rows.withColumn("__u", u).withColumn("__pk", pk).join(
                cond.withColumnRenamed("pk", "__pk"), "__pk", "left")
            vals = F.coalesce(F.col("vals"), mvals)
            cum = F.coalesce(F.col("cum"), mcum)
            idx = F.least(F.size(F.filter(cum, lambda c: c <= F.col("__u"))), F.size(vals) - F.lit(1))
            rows = rows.withColumn(x, F.element_at(vals, idx + F.lit(1)).cast("int")).drop("__u", "__pk", "vals", "cum")
        return self._decode(rows, seed)

    def _decode(self, rows: DataFrame, seed: int) -> DataFrame:
        out = []
        for c in self.columns:
            t = self.types[c]
            if c in self.categories:
                arr = F.array(*[F.lit(v) for v in self.categories[c]])
                out.append(F.element_at(arr, F.col(c) + F.lit(1)).cast(t).alias(c))
            else:
                lo, hi = self.bins[c]
                w = (hi - lo) / self.histogram_size if hi > lo else 0.0
                v = F.lit(lo) + (F.col(c).cast("double") + uniform01(seeded_key(seed, f"bnv:{c}", ROW_ID))) * F.lit(w)
                v = F.least(v, F.lit(hi))
                if isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
                    v = F.floor(v)
                out.append(v.cast(t).alias(c))
        return rows.select(ROW_ID, *out)


class BayesNetDP(BayesNet):
    """The same with epsilon = 0.1, half for structure, half for the counts.

    The number of rows, the category lists and the ranges are taken as public
    and are not noised."""

    name = "bayes_net_dp"

    def __init__(self, epsilon: float = 0.1, **kwargs):
        super().__init__(epsilon=epsilon, **kwargs)

