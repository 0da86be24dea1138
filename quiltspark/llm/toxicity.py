"""Operator 10: toxicity by subword-bag embeddings and a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (and of
the whole word) in a hashed table, so a misspelling nobody has seen shares most
of its vector with the word.  Every run of ``WORDS`` words of a text is a window
(a shorter text is one); a window's vector is the mean over its ``WORDS`` places
(a word that the window repeats and a place after the text's end count as zero
vectors, so neither one word said again and again nor a short text weighs more
than its distinct words), and a linear softmax over it gives the window's
probability.  The text's score is that of its highest window, so a few toxic
words in a very long text are not averaged away, wherever they stand.  Table and
softmax are trained jointly in numpy by mini-batches: first on windows drawn all
over the texts (one of every ``WORDS`` starts) under their text's label, then on
each text's highest window.

The model is fitted on a bounded sample of labelled rows: at most
``TRAIN_ROWS`` rows of either class, in hash order of the id, and of those the
whole texts up to ``TRAIN_CHARS`` characters in all.  Everything is scored.
Once the softmax is linear, a word adds one number, so scoring is a cached
look-up per word and a running sum.  The numbers are multiples of ``UNIT``, so
that running sums are exact and a score does not depend on the texts beside it.

A word is what stands between white space; one of more than ``LONGEST`` signs (a
text of a script without spaces, for example) is read whole, in pieces that each
take a place.  A null, empty or blank text has no window and gets the softmax of the bias
alone.  Labels that are null, and ids labelled differently (then 1 wins), are
handled; without labels of both classes every score is the share of toxic rows.
Repeated rows get equal scores.  Columns named like the results are refused;
any others are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text_crc

BUCKETS = 1 << 16
DIMS = 8
WORDS = 32
TRAIN_ROWS = (6_000, 3_000)  # clean, toxic
TRAIN_CHARS = 40_000_000
STEPS = 400  # at least, also on a small sample
CACHE_WORDS = 1_000_000
UNIT = 2.0**-32
LONGEST, SHARED = 64, 4
_EDGE = ".,;:!?\"'()[]{}|<>-–—…«»„“”‘’¡¿"


def places(text: str | None) -> list[str]:
    """The words at a text's places; one of more than ``LONGEST`` signs is one place for
    each piece of it.  Pieces share ``SHARED`` signs, so every n-gram is in one whole."""
    words = (text or "").split()
    if not words or max(map(len, words)) <= LONGEST:
        return words
    out = []
    for w in words:
        if len(w) > LONGEST:
            w = w.strip(_EDGE)
            out.extend(w[a : a + LONGEST] for a in range(0, max(1, len(w) - SHARED), LONGEST - SHARED))
        else:
            out.append(w)
    return out


def grams(word: str) -> list[str]:
    """Itself and its n-grams of 3 to 5 characters, edges marked; none for a bare edge sign."""
    bare = word.lower().strip(_EDGE)
    if not bare:
        return []
    w = f"<{bare}>"
    n = len(w) + 1
    out = [w[i : i + k] for k in (3, 4, 5) for i in range(n - k)]
    out.append(bare)
    return out


class Buckets(dict):
    """n-gram -> bucket, worked out on first sight."""

    def __missing__(self, gram: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[gram] = found = zlib.crc32(gram.encode()) % BUCKETS
        return found


class Weights(dict):
    """n-gram -> weight, worked out on first sight."""

    def __init__(self, weight: list[float]):
        self.weight = weight

    def __missing__(self, gram: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[gram] = found = self.weight[zlib.crc32(gram.encode()) % BUCKETS]
        return found


@dataclass
class Model:
    """``weight``: what an n-gram adds to the difference of the two logits."""

    weight: list[float]
    bias: float


def _softmax(diff: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(diff, -50, 50)))


def entered(seq: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each place of texts that stand one after another, the first place at which a
    window can start that holds it and no earlier place of the same word."""
    gap = np.full(len(seq), WORDS, np.int32)
    for k in range(min(WORDS, len(seq)) - 1, 0, -1):
        np.putmask(gap[k:], seq[k:] == seq[:-k], k)
    return np.maximum(np.arange(1, len(seq) + 1) - gap, np.repeat(start, length))


def window_sums(value: np.ndarray, first: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each place the sum over the distinct words of the window that starts there;
    -inf where the text goes on for less than a window (but for its first place)."""
    value = np.rint(value / UNIT) * UNIT
    change = np.bincount(first, value, len(value))
    change[1:] -= value[:-1]
    sums = np.cumsum(change)
    place = np.arange(len(value))
    sums[place > np.repeat(np.maximum(start, start + length - WORDS), length)] = -np.inf
    return sums


def train(texts: list[str], toxic: list[int], base_rate: float, epochs: int = 9, seed: int = 11) -> Model:
    """Fit table and softmax jointly (Adagrad)."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        rate = min(max(base_rate, 1e-6), 1 - 1e-6)
        return Model([0.0] * BUCKETS, float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(seed)
    ids: dict[str, int] = {}
    bucket = Buckets()
    flat, size, seq, length, doc = array("i"), array("i"), array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        words = places(text)
        if not words:
            continue
        for w in words:
            at = ids.get(w)
            if at is None:
                at = ids[w] = len(ids)
                found = [bucket[g] for g in grams(w)]
                flat.extend(found)
                size.append(len(found))
            seq.append(at)
        length.append(len(words))
        doc.append(d)
    del ids, bucket
    flat, size, seq, length, doc = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (flat, size, seq, length, doc))
    if not len(length):
        return train([], [], base_rate)
    at, start = (np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[:-1] for x in (size, length))
    first, end = entered(seq, start, length).astype(np.int32), np.repeat(start + length, length).astype(np.int32)
    # every WORDS starts of a text are a block
    blocks = -(-np.maximum(length - WORDS + 1, 1) // WORDS)
    of = np.repeat(np.arange(len(length)), blocks)
    block = start[of] + WORDS * (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    room = np.minimum(WORDS, np.maximum(start + length - WORDS, start)[of] + 1 - block)
    doc_of = doc[of]
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    table = rng.normal(0, 0.05, (BUCKETS, DIMS))
    soft = rng.normal(0, 0.05, (DIMS, 2))
    bias = np.zeros(2)
    heat_t, heat_s, heat_b = np.full((BUCKETS, 1), 1e-6), np.full((DIMS, 2), 1e-6), np.full(2, 1e-6)

    def window_logits() -> np.ndarray:
        value = table @ (soft[:, 1] - soft[:, 0])
        per_word = np.bincount(owner, value[flat], len(size)) / np.maximum(size, 1)
        return window_sums(per_word[seq], first, start, length) / WORDS + bias[1] - bias[0]

    def highest(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The start of the highest window of each block, and its logit."""
        best = np.maximum.reduceat(logits, block)
        top = np.flatnonzero(logits == np.repeat(best, np.diff(np.append(block, len(seq)))))
        return top[np.searchsorted(top, block)], best

    def step(batch: np.ndarray, label: np.ndarray, rate: float) -> None:
        nonlocal table, soft, bias
        place = batch[:, None] + np.arange(WORDS)
        within = place < end[batch][:, None]
        place[~within] = 0
        within &= first[place] <= batch[:, None]
        n, w = within.sum(1), seq[place[within]]
        k = size[w]
        where = flat[np.repeat(at[w] - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(k.sum())]
        share = np.repeat(1 / (np.maximum(k, 1) * WORDS), k)
        window = np.repeat(np.repeat(np.arange(len(batch)), n), k)
        x = np.stack([np.bincount(window, table[where, j] * share, len(batch)) for j in range(DIMS)], 1)
        wrong = (_softmax(x @ (soft[:, 1] - soft[:, 0]) + bias[1] - bias[0]) - label) / len(batch)
        g = np.bincount(where, wrong[window] * share, BUCKETS)[:, None] * (soft[:, 1] - soft[:, 0])[None, :]
        half = x.T @ wrong
        gs, gb = np.stack([-half, half], 1) + 1e-5 * soft, np.array([-wrong.sum(), wrong.sum()])
        heat_t[:] += (g**2).mean(1, keepdims=True)
        heat_s[:] += gs**2
        heat_b[:] += gb**2
        table -= rate * g / np.sqrt(heat_t)
        soft -= rate * gs / np.sqrt(heat_s)
        bias -= rate * gb / np.sqrt(heat_b)

    order = np.arange(len(block))
    clean = order[y[doc_of] == 0]
    epoch = steps = 0
    while epoch < epochs or steps < STEPS:
        at_of = block + (rng.random(len(block)) * room).astype(np.int64)
        if epoch < 2:
            chosen = order if len(order) <= 60_000 else rng.choice(order, 60_000, replace=False)
            batch, label = at_of[chosen], y[doc_of[chosen]]
        else:
            high, logits = highest(window_logits())
            ranked = np.lexsort((logits, doc_of))
            top = ranked[np.append(np.flatnonzero(np.diff(doc_of[ranked])), len(ranked) - 1)]
            hard = clean[np.argsort(logits[clean])[-len(top) :]]
            some = rng.choice(clean, min(len(clean), len(top)), replace=False)
            best = np.unique(np.concatenate([top, hard]))
            batch = np.concatenate([high[best], at_of[some]])
            label = y[doc_of[np.concatenate([best, some])]]
        mixed = rng.permutation(len(batch))
        batch, label = batch[mixed], label[mixed]
        size_of = min(512, max(32, len(batch) // 16))
        for a in range(0, len(batch), size_of):
            step(batch[a : a + size_of], label[a : a + size_of], 0.3)
            steps += 1
        epoch += 1
    logits = highest(window_logits())[1]
    best = np.full(len(texts), bias[1] - bias[0])
    np.maximum.at(best, doc_of, logits)
    return Model((table @ (soft[:, 1] - soft[:, 0])).tolist(), float(bias[1] - bias[0]) - fairest_cut(best, y))


def fairest_cut(logits: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the fewest errors on the training texts."""
    rank = np.argsort(logits, kind="stable")
    z, truth = logits[rank], y[rank]
    errors = np.concatenate(([0], np.cumsum(truth))) + np.concatenate((np.cumsum((1 - truth)[::-1])[::-1], [0]))
    gap = np.concatenate(([0], np.diff(z), [0]))
    gap[errors > errors.min()] = -1
    at = int(gap.argmax())
    return float((z[max(at - 1, 0)] + z[min(at, len(z) - 1)]) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on the rows of ``labels`` whose crc32(doc_id as text) mod 5 is not 0."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_t_toxic"))
    known = known.filter(id_text_crc() % 5 != 0)
    order = F.xxhash64("doc_id")
    counts = {int(r[0]): int(r[1]) for r in known.groupBy("_t_toxic").agg(F.count(F.lit(1))).collect()}
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    rows = [known.filter(F.col("_t_toxic") == c).orderBy(order, "doc_id").limit(TRAIN_ROWS[c]) for c in (0, 1)]
    some = rows[0].union(rows[1]).withColumnRenamed("doc_id", "_t_id")
    # at most sum(TRAIN_ROWS) ids
    texts = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_t_id"))
    texts = texts.groupBy("_t_id", "_t_toxic").agg(F.min("text").alias("text"))
    # the bounded sample meets in one task, which fits the model and returns it
    sample = texts.repartition(1).sortWithinPartitions(F.xxhash64("_t_id"), "_t_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, toxic, room = [], [], TRAIN_CHARS
        for batch in batches:
            for text, c in zip(batch.column("text").to_pylist(), batch.column("_t_toxic").to_pylist(), strict=True):
                if len(text or "") <= room:  # a text too long for what is left is no sample; later ones are
                    room -= len(text or "")
                    got.append(text or "")
                    toxic.append(c)
        model = train(got, toxic, rate)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight], pa.list_(pa.float64())), pa.array([model.bias])], ["weight", "bias"])

    rows = sample.mapInArrow(run, "weight array<double>, bias double").collect()
    return Model(list(rows[0]["weight"]), rows[0]["bias"]) if rows else train([], [], rate)


class Scorer:
    """Keeps what it has worked out for a word; one per worker process and model."""

    def __init__(self, model: Model):
        self.bias, self.gram, self.word, self.value = model.bias, Weights(model.weight), {}, array("d")

    def _learn(self, words: set[str]) -> None:
        if len(self.word) > CACHE_WORDS:
            self.word, self.value = {}, array("d")
        of = self.gram.__getitem__
        for w in words:
            if w not in self.word:
                found = grams(w)
                self.word[w] = len(self.value)
                self.value.append(sum(map(of, found)) / len(found) if found else 0.0)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        split = [places(t) for t in texts]
        length = np.array([len(x) for x in split], np.int64)
        words = [w for x in split for w in x]
        out = np.full(len(texts), self.bias)
        if words:
            self._learn(set(words))
            seq = np.fromiter(map(self.word.__getitem__, words), np.int32, len(words))
            some = length > 0
            n = length[some]
            start = np.cumsum(n) - n
            sums = window_sums(np.frombuffer(self.value)[seq], entered(seq, start, n), start, n)
            out[some] = np.maximum.reduceat(sums, start) / WORDS + self.bias
        return out

    def logit(self, text: str | None) -> float:
        return float(self.logits([text])[0])


_SCORERS: dict[int, Scorer] = {}


def _scorer(mark: int, model: Model) -> Scorer:
    """The worker's scorer of a model.  A function of the module, so that tasks of one worker
    share its words; a nested one would take a copy of the dictionary along."""
    if mark not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[mark] = Scorer(model)
    return _SCORERS[mark]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (probability of toxic) and ``predicted`` (1 from 0.5 on)."""
    if bad := {"score", "predicted"} & set(docs.columns):
        raise ValueError(f"columns {sorted(bad)} are reserved")
    names = docs.columns
    mark = zlib.crc32(np.append(np.array(model.weight, float), model.bias).tobytes())

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits = _scorer(mark, model).logits
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                p = _softmax(logits(some.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    extra = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.mapInArrow(rate, T.StructType([*docs.schema.fields, *extra]))
