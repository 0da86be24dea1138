"""Sequential CART synthesis (the ``synthpop`` method ``cart``).

Column 1 is a bootstrap of the training values.  Column i is modelled from
columns < i with an MLlib decision tree -- a classification tree for a
category, a regression tree for a number; its leaves keep their training
values as donors.  A synthetic row runs down the tree on its already
synthesised columns and takes the value of a donor drawn uniformly (md5) from
the leaf it lands in, so a category is drawn with its share in the leaf.
Donors are stored as ``(leaf, dense index, value)`` so the draw is an equi-join
on ``(leaf, index)``; the per-leaf donor counts (at most 2^max_depth numbers)
travel as a literal map.

Categories are the columns named in ``categorical``, strings, and numeric
columns of fewer than ``minnumlevels`` distinct values; trees split them as
unordered sets.  A category of more than ``max_levels`` levels is treated as an
ordered number (a string column of so many is refused: encode it first).  A null
is a level of its own: of a category directly; for a number, being null is drawn
first as a category of two levels and the value after it from the rows that have
one.  A column of one level, or of nulls alone, needs no tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltspark.functions.keys import key_to_long, seeded_key
from quiltspark.operators.aggregates import distinct_counts
from quiltspark.operators.generators.base import ROW_ID, Generator, row_index
from quiltspark.operators.positions import slices_for, value_position
from quiltspark.session import materialize, spread

_MADE = ("__x", "__leafd", "__pred", "__raw", "__prob")


def _q(c: str):
    return F.col(f"`{c}`")


class _Step:
    """One drawn column: its tree (or none), its donors by leaf and their numbers."""

    def __init__(self, out: str, inputs: list[str], model, donors: DataFrame, counts: dict[int, int]):
        self.out, self.inputs, self.model, self.donors, self.counts = out, inputs, model, donors, counts

    def leaves(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            return df.withColumn("__leaf", F.lit(0))
        x = VectorAssembler(inputCols=self.inputs, outputCol="__x").transform(df)
        return self.model.transform(x).withColumn("__leaf", F.col("__leafd").cast("int")).drop(*_MADE)


class CartSequential(Generator):
    name = "cart"

    def __init__(self, max_depth: int = 10, min_instances_per_node: int = 5, seed: int = 0, minnumlevels: int = 3,
                 max_levels: int = 60, categorical: Sequence[str] | None = None):
        self.max_depth = max_depth
        self.min_instances = min_instances_per_node
        self.seed = seed
        self.minnumlevels = minnumlevels
        self.max_levels = max_levels
        self.categorical = None if categorical is None else list(categorical)

    def _kinds(self, train: DataFrame) -> None:
        """Per column: distinct values, number of nulls, category or number."""
        levels = {r["column"]: r["n_distinct"] for r in distinct_counts(train, self.columns).collect()}
        nulls = train.agg(*[F.count(F.when(_q(c).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(self.columns)]).first()
        self.nulls = {c: nulls[f"n{i}"] for i, c in enumerate(self.columns)}
        named = set(self.categorical or ())
        self.levels, self.category = levels, set()
        for c in self.columns:
            text = isinstance(self.types[c], T.StringType)
            if text and levels[c] > self.max_levels:
                raise ValueError(f"{c!r} has {levels[c]} levels, more than max_levels={self.max_levels}; encode it as a number")
            if levels[c] <= self.max_levels and (text or c in named or levels[c] < self.minnumlevels):
                self.category.add(c)

    def _constant(self, c: str) -> bool:
        return self.levels[c] == 0 or (self.levels[c] == 1 and not self.nulls[c])

    def _features(self, df: DataFrame, c: str) -> tuple[DataFrame, list[str]]:
        """The inputs that ``c`` gives to later trees."""
        if self._constant(c):
            return df, []
        i = self.columns.index(c)
        if c in self.category:
            if c not in self.indexers:
                self.indexers[c] = StringIndexer(inputCol="__text", outputCol=f"__f{i}", handleInvalid="keep").fit(
                    df.select(_q(c).cast("string").alias("__text")))
            return self.indexers[c].transform(df.withColumn("__text", _q(c).cast("string"))).drop("__text"), [f"__f{i}"]
        out = df.withColumn(f"__f{i}", F.coalesce(_q(c).cast("double"), F.lit(0.0)))
        if not self.nulls[c]:
            return out, [f"__f{i}"]
        return out.withColumn(f"__n{i}", _q(c).isNull().cast("double")), [f"__f{i}", f"__n{i}"]

    def _step(self, rows: DataFrame, n: int, c: str, out: str, label: str | None, classes: bool, inputs: list[str]) -> _Step:
        """Grow the tree of ``label`` over the ``n`` ``rows`` and keep the values of ``c`` by leaf."""
        step = _Step(out, inputs, None, None, None)
        if inputs and label is not None:
            most = max([self.levels[k] for k in self.category], default=0) + 2
            common = dict(featuresCol="__x", labelCol=label, predictionCol="__pred", leafCol="__leafd", maxDepth=self.max_depth,
                          minInstancesPerNode=self.min_instances, maxBins=max(32, most), seed=self.seed)
            tree = (DecisionTreeClassifier(rawPredictionCol="__raw", probabilityCol="__prob", **common) if classes
                    else DecisionTreeRegressor(**common))
            step.model = tree.fit(VectorAssembler(inputCols=inputs, outputCol="__x").transform(rows))
        leaves = step.leaves(rows).select(ROW_ID, "__leaf", _q(c).alias("__val"))
        keyed = leaves.withColumn("__h", key_to_long(seeded_key(self.seed, f"donor:{out}", ROW_ID)))
        # at most 2^max_depth leaves
        ranked = value_position(keyed, ["__h"], out="__idx", partition_col="__leaf", ranges=slices_for(n), few_groups=True)
        step.donors = materialize(ranked.select("__leaf", "__idx", "__val"), "donors")
        step.counts = {int(r["__leaf"]): int(r["n"]) for r in step.donors.groupBy("__leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
        return step

    def fit(self, train: DataFrame) -> "CartSequential":
        source = materialize(train, "train")  # what comes before is worked out once
        self._train_ids = source.select(ROW_ID)
        train = spread(source, ROW_ID).persist()
        self._m = train.count()
        self.columns = [c for c in train.columns if c != ROW_ID]
        self.types = {f.name: f.dataType for f in train.schema.fields}
        self._kinds(train)
        self.indexers, self.steps = {}, []
        rows, inputs = train, []
        for i, c in enumerate(self.columns):
            rows, made = self._features(rows, c)
            if not inputs or self._constant(c):  # nulls are donors like any value
                self.steps.append(self._step(rows, self._m, c, c, None, False, inputs))
            elif c in self.category:
                self.steps.append(self._step(rows, self._m, c, c, f"__f{i}", True, inputs))
            else:
                if self.nulls[c]:
                    self.steps.append(self._step(rows, self._m, f"__n{i}", f"__null{i}", f"__n{i}", True, inputs))
                there = rows.where(_q(c).isNotNull())
                self.steps.append(self._step(there, self._m - self.nulls[c], c, c, f"__f{i}", False, inputs))
            inputs = [*inputs, *made]
        train.unpersist()
        return self

    def sample(self, n: int, seed: int = 0) -> DataFrame:
        rows = row_index(self._train_ids, self._m, n)
        for step in self.steps:
            rows = step.leaves(rows)
            size = F.create_map(*[x for k, v in step.counts.items() for x in (F.lit(k), F.lit(v))])[F.col("__leaf")]
            rows = rows.withColumn("__idx", key_to_long(seeded_key(seed, f"cart:{step.out}", ROW_ID)) % size)
            rows = rows.join(step.donors, ["__leaf", "__idx"], "left").withColumnRenamed("__val", step.out).drop("__leaf", "__idx")
            if step.out in self.columns:
                drawn = f"__null{self.columns.index(step.out)}"
                if drawn in rows.columns:
                    rows = rows.withColumn(step.out, F.when(F.col(drawn) == 0, _q(step.out))).drop(drawn)
                rows, _ = self._features(rows, step.out)
        return rows.select(ROW_ID, *[_q(c).cast(self.types[c]).alias(c) for c in self.columns])
