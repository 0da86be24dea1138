"""Generator interface (G1), registry dispatch (G2), identity generator
and the per-split fan-out (G7).

A generator is fitted on one part (``__row_id`` + numeric columns) and
samples ``n`` rows with a dense ``__row_id``.  Row indices for the sample are
derived from the training ids (``id + m*t``), so the work grows with the data
and no driver-side range is materialised.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltspark.operators.positions import value_position
from quiltspark.operators.sampling import head_n, top_up_samples
from quiltspark.session import materialize

ROW_ID = "__row_id"


def complete_rows(train: DataFrame) -> DataFrame:
    """The rows without nulls, with dense ids again if any row went."""
    kept = train.na.drop()
    if kept.count() == train.count():
        return kept
    ranked = value_position(kept, [ROW_ID], out="__dense")
    return ranked.drop(ROW_ID).withColumnRenamed("__dense", ROW_ID).select(*train.columns)


def row_index(train_ids: DataFrame, m: int, n: int) -> DataFrame:
    """``__row_id`` = 0..n-1 derived from a dense id column 0..m-1."""
    reps = max(1, -(-n // m))
    return (
        train_ids.select(F.col(ROW_ID), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("__t"))
        .select((F.col(ROW_ID) + F.lit(m) * F.col("__t")).alias(ROW_ID))
        .where(F.col(ROW_ID) < F.lit(n))
    )


class Generator(ABC):
    """User extension point -- ``fit`` on a part, ``sample`` n rows."""

    name = "generator"

    def __str__(self) -> str:
        return self.name

    @abstractmethod
    def fit(self, train: DataFrame) -> "Generator":
        ...

    @abstractmethod
    def sample(self, n: int, seed: int = 0) -> DataFrame:
        ...

    def generate(self, train: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
        self.fit(train)
        m = self._m
        # M7: some generators may return fewer rows than asked for; written, so that counting them draws them only once
        out = materialize(self.sample(n if n is not None else m, seed), "sample")
        return top_up_samples(out, n if n is not None else m, seed)


class Identity(Generator):
    """G3 (``debug``): returns the training rows unchanged (cut / topped up to n)."""

    name = "debug"

    def fit(self, train: DataFrame) -> "Identity":
        self._train = train
        self._m = train.count()
        return self

    def sample(self, n: int, seed: int = 0) -> DataFrame:
        return head_n(self._train, n) if n <= self._m else top_up_samples(self._train, n, seed)


def registry() -> dict[str, type]:
    from quiltspark.operators.generators.bayes_net import BayesNet, BayesNetDP
    from quiltspark.operators.generators.cart import CartSequential

    return {
        "debug": Identity,
        "bayes_net": BayesNet,
        "datasynthesizer": BayesNet,
        "privbayes": BayesNet,
        "bayes_net_dp": BayesNetDP,
        "datasynthesizer-dp": BayesNetDP,
        "cart": CartSequential,
        "synthpop": CartSequential,
    }


def make_generator(model: str | Generator, **kwargs) -> Generator:
    """Name -> generator instance; instances pass through."""
    if isinstance(model, Generator):
        return model
    reg = registry()
    if model not in reg:
        raise NotImplementedError(f"generator {model!r} is not available; known: {sorted(reg)}")
    return reg[model](**kwargs)


def generate_synthetic_data(train: DataFrame, model: str | Generator, n: int | None = None, seed: int = 0,
                            **kwargs) -> DataFrame:
    """G2 entry: fit ``model`` on ``train`` and sample ``n`` rows."""
    return make_generator(model, **kwargs).generate(train, n, seed)


def fan_out(parts: Mapping[str, DataFrame], models: Mapping[str, str | Generator], n: int, seed: int = 0,
            max_workers: int | None = None, categorical: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Fit and sample every split with its own model as concurrent Spark jobs.

    ``categorical`` names the encoded categories; a model that tells them from
    numbers (an attribute ``categorical`` that is still None) gets those of its split.

    Each split's jobs run from a driver thread in their own scheduler pool;
    results are written to the checkpoint folder so the re-join reads
    materialised parts.
    """
    names = list(parts)

    def run(i_name):
        i, name = i_name
        df0 = parts[name]
        sc = df0.sparkSession.sparkContext
        sc.setLocalProperty("spark.scheduler.pool", f"split-{name}")
        generator = make_generator(models[name])
        if getattr(generator, "categorical", ()) is None:
            generator.categorical = [c for c in df0.columns if c in set(categorical)]
        out = generator.generate(df0, n, seed + 1000 * i)
        return name, materialize(out, f"part-{name}")

    with ThreadPoolExecutor(max_workers=max_workers or len(names)) as ex:
        return dict(ex.map(run, enumerate(names)))
