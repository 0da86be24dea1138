"""Operator 13: ranked lexical search, many queries at once by common subexpressions.

Queries are evaluated in blocks of items.  A score is a sum over terms, so what
several items have in common need be added up once per document:

1. Mining.  Terms that stand in exactly the same items are one set.  Then, again
   and again, the two sets (or unions made before) that the most items share are
   united, as long as two items share them.  The unions form a DAG; each item is
   a sum of a few of its nodes (``plan``).
2. One pass over the documents counts, of each text, all terms and those of the
   block, and keeps the latter; each task adds its document frequencies.
3. A pass over what was kept works out, for many documents at a time, one partial
   accumulator per set, once; then the unions level by level along the DAG; then
   the items.  A task keeps the k best of each item; Spark ranks what tasks keep.

Which unions are made changes the work, never a score: all are sums of whole
numbers.

Null texts and texts without terms match nothing and count for nothing.  Rows
that repeat a doc_id are documents of their own; a null doc_id ranks behind all
others of its score.  Rows that repeat an item_id are one item with the terms of
all; a null item_id is an item too.  Items without terms have no rows.  Empty
tables give an empty result.  Texts of any length are read whole.  Only the named
columns are read, so other names cannot clash.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Items of a block, documents worked out at a time, candidates held by a task, and the shared
#: sets of one item among which unions are looked for (more only means fewer unions).
BLOCK_ITEMS, TOGETHER, HELD, MINED = 512, 512, 400_000, 256
_LAST = np.iinfo(np.int64).max
_TERM = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_COLUMNS = ["doc_id", "n", "terms", "times", "term", "docs"]
SURVEY = "doc_id long, n long, terms binary, times binary, term long, docs long"
N_TEXTS, N_TERMS = -1, -2  # rows of the survey with totals


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8: what stands between ASCII signs other than letters and
    digits, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM).split()


class Plan:
    """Sets of terms, the DAG of their unions, and the nodes whose sum is an item."""

    def __init__(self, items: list[set[int]]):
        holders = defaultdict(list)
        for k, terms in enumerate(items):
            for t in terms:
                holders[t].append(k)
        by_items = defaultdict(list)
        for t in sorted(holders):
            by_items[tuple(holders[t])].append(t)
        #: term -> its set
        self.set_of = {t: s for s, terms in enumerate(by_items.values()) for t in terms}
        self.sets = len(by_items)
        #: (node, node) of each union; unions are numbered after the sets
        self.unions: list[tuple[int, int]] = []
        parts: list[set[int]] = [set() for _ in items]
        for s, owners in enumerate(by_items):
            for k in owners:
                parts[k].add(s)
        self._mine(parts, Counter({s: len(owners) for s, owners in enumerate(by_items)}))
        self.items = [sorted(p) for p in parts]
        self.levels = self._by_level()

    def _mine(self, parts: list[set[int]], shared: Counter) -> None:
        owners: dict[tuple[int, int], set[int]] = defaultdict(set)
        for k, p in enumerate(parts):
            some = sorted(sorted(x for x in p if shared[x] > 1), key=lambda x: -shared[x])[:MINED]
            for pair in combinations(sorted(some), 2):
                owners[pair].add(k)
        heap = [(-len(o), pair) for pair, o in owners.items() if len(o) > 1]
        heapq.heapify(heap)
        while heap:
            n, pair = heapq.heappop(heap)
            mine = {k for k in owners[pair] if pair[0] in parts[k] and pair[1] in parts[k]}
            owners[pair] = mine
            if len(mine) < 2:
                continue
            if len(mine) < -n:
                heapq.heappush(heap, (-len(mine), pair))
                continue
            node = self.sets + len(self.unions)
            self.unions.append(pair)
            new: dict[tuple[int, int], set[int]] = defaultdict(set)
            for k in mine:
                parts[k] -= {*pair}
                for x in sorted(x for x in parts[k] if shared[x] > 1)[:MINED]:
                    new[x, node].add(k)
                parts[k].add(node)
            shared[node] = len(mine)
            for other, o in new.items():
                if len(o) > 1:
                    owners[other] = o
                    heapq.heappush(heap, (-len(o), other))

    def _by_level(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Unions that can be worked out together: (nodes, left, right) per level."""
        depth = [0] * self.sets
        at: dict[int, list[int]] = defaultdict(list)
        for k, (a, b) in enumerate(self.unions):
            depth.append(1 + max(depth[a], depth[b]))
            at[depth[-1]].append(k)
        return [tuple(np.array(x, np.int64) for x in zip(*[(self.sets + k, *self.unions[k]) for k in at[d]], strict=True)) for d in sorted(at)]

    def additions(self) -> int:
        """Sums of accumulators that an evaluation takes."""
        return len(self.unions) + sum(max(0, len(p) - 1) for p in self.items)

    def scores(self, node: np.ndarray, doc: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
        """(items, documents) sums of the values, which belong to a set and a document each."""
        acc = np.zeros((self.sets + len(self.unions), n_docs), np.int64)
        np.add.at(acc.reshape(-1), node * n_docs + doc, value)
        for nodes, left, right in self.levels:
            acc[nodes] = acc[left] + acc[right]
        return np.stack([acc[p].sum(0) if len(p) != 1 else acc[p[0]] for p in self.items])


def _surveyor(vocabulary: dict[bytes, int]):
    """Rows of documents that hold a term of the block; then rows (term, docs) with this
    task's document frequencies and totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, width = vocabulary.get, len(vocabulary)
        docs, texts, total = np.zeros(width, np.int64), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                n, found, size = [], [], []
                for text in part.column("text").to_pylist():
                    terms = terms_of(text)
                    mine = [i for i in map(get, terms) if i is not None]
                    n.append(len(terms))
                    size.append(len(mine))
                    found += mine
                texts += sum(x > 0 for x in n)
                total += sum(n)
                key = np.repeat(np.arange(len(n)), size) * max(1, width) + np.array(found, np.int64)
                distinct, times = np.unique(key, return_counts=True)
                owner, term = np.divmod(distinct, max(1, width))
                docs += np.bincount(term, minlength=width).astype(np.int64)[:width]
                cut = 4 * np.searchsorted(owner, np.arange(len(n) + 1))
                some = np.flatnonzero(np.diff(cut))
                terms_raw, times_raw = term.astype("<u4").tobytes(), times.astype("<u4").tobytes()
                blobs = [[raw[cut[k] : cut[k + 1]] for k in some.tolist()] for raw in (terms_raw, times_raw)]
                nothing = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(some)), pa.array(np.array(n, np.int64)[some]), *[pa.array(b, pa.binary()) for b in blobs], nothing, nothing], _COLUMNS
                )
        term = pa.array([*np.flatnonzero(docs).tolist(), N_TEXTS, N_TERMS], pa.int64())
        count = pa.array([*docs[docs > 0].tolist(), texts, total], pa.int64())
        m = len(term)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(m, pa.int64())] * 2, *[pa.nulls(m, pa.binary())] * 2, term, count], _COLUMNS)

    return run


def weights(docs: np.ndarray, n_texts: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2df + 1))) per term."""
    return np.array([math.floor(1000 * math.log((2 * n_texts + 2) / (2 * d + 1))) for d in docs.tolist()], np.int64)


def lengths(n: np.ndarray, n_texts: int, n_terms: int) -> np.ndarray:
    """The length part m of documents of ``n`` terms, exact for any totals."""
    return np.array([50 + 50 * x * n_texts // n_terms for x in n.tolist()], np.int64)


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (highest score, then smallest doc) of each item, in order."""
    order = np.lexsort((doc, -score, item))
    item, score, doc = item[order], score[order], doc[order]
    first = np.searchsorted(item, item)
    keep = np.arange(len(item)) - first < k
    return item[keep], score[keep], doc[keep]


def _scorer(plan: Plan, set_of: np.ndarray, weight: np.ndarray, n_texts: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = tuple(np.zeros(0, np.int64) for _ in range(3))
        kth = np.ones(len(plan.items), np.int64)
        new: list[tuple] = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                ids = part.column("doc_id").fill_null(int(_LAST)).to_numpy()
                blobs = part.column("terms").to_pylist()
                term = np.frombuffer(b"".join(blobs), "<u4").astype(np.int64)
                tf = np.frombuffer(b"".join(part.column("times").to_pylist()), "<u4").astype(np.int64)
                doc = np.repeat(np.arange(len(ids)), [len(b) // 4 for b in blobs])
                m = lengths(part.column("n").to_numpy(), n_texts, n_terms)[doc]
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
                scores = plan.scores(set_of[term], doc, value, len(ids))
                item, row = np.nonzero(scores >= kth[:, None])
                new.append((item, scores[item, row], ids[row]))
                held += len(item)
                if held > HELD or len(kept[0]) < k * len(kth):
                    kept = _best(*[np.concatenate(x) for x in zip(kept, *new, strict=True)], k)
                    new, held = [], 0
                    full = np.bincount(kept[0], minlength=len(kth)) == k
                    last = np.searchsorted(kept[0], np.arange(len(kth)), side="right") - 1
                    kth[full] = kept[1][last[full]]
        item, score, doc = _best(*[np.concatenate(x) for x in zip(kept, *new, strict=True)], k)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=doc == _LAST), pa.array(score)], ["item", "doc_id", "score"])

    return run


def _block(docs: DataFrame, items: list[tuple[int | None, list[str]]], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: n for n, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    coded = {t.encode(): n for t, n in vocabulary.items()}
    survey = staged(docs.mapInArrow(_surveyor(coded), SURVEY), "terms")
    sums = dict(survey.filter("term is not null").groupBy("term").agg(F.sum("docs")).collect())  # a row per term of the block
    n_texts, n_terms = sums.pop(N_TEXTS, 0) or 0, sums.pop(N_TERMS, 0) or 0
    df = np.array([sums.get(n, 0) for n in range(len(vocabulary))], np.int64)
    plan = Plan([{vocabulary[t] for t in terms} for _, terms in items])
    set_of = np.array([plan.set_of[n] for n in range(len(vocabulary))], np.int64)
    # at most ``k`` rows an item and task
    found = survey.filter("term is null").select("doc_id", "n", "terms", "times")
    found = found.mapInArrow(_scorer(plan, set_of, weights(df, n_texts), n_texts, n_terms, k), "item long, doc_id long, score long")
    named = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], "item long, item_id long")  # one block of items
    return found.join(F.broadcast(named), "item").select("item_id", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents with a score above 0 of every item.

    ``docs``: doc_id, text; ``items``: item_id, text.  Items are read a block of about
    ``BLOCK_ITEMS`` at a time; each block passes over the documents."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    each = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(found).alias("term"))
    asked = staged(each.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")), "items")
    blocks = max(1, math.ceil(asked.count() / BLOCK_ITEMS))
    out = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        if rows:
            some = _block(docs, [(r["item_id"], r["terms"]) for r in rows], k)
            out = some if out is None else out.unionByName(some)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
