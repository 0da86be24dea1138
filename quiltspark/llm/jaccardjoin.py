"""Operator 2: n-gram Jaccard join by count-vector R-trees.

A document's set is the distinct 5-word shingles of its whole text.  Equal sets
are one class, found by key, and only classes are compared.  R-trees over the
classes' count vectors find what may be linked; what their bounds leave is
verified on the sets.  So that no tree has to hold the corpus, classes first
meet in groups that together hold every linked pair:

* All shingles are put in one order: by how often the corpus has them, as far as
  a first pass could tell (at most ``HEAVY`` counts are kept), then by hash.  A
  set of n shingles is listed under its first n//4 + l of them, l = 1 + n//20.
  Two linked sets have at least the lesser l of these shingles in common,
  whatever the order is; the order only keeps the lists short.
* Pairs that meet in lists of up to ``SHORT`` classes are counted.  A pair that
  meets in short lists alone and fewer than l times is not linked; the others
  form a group of two (joined with those of the same first class).
* A longer list is a group as a whole, named by its smallest class, so the
  lists of one family of copies are mostly one group.  A class that is in fewer
  long lists than the l of any set it may be linked with (a common phrase or two)
  is in none of these groups: it must also meet its partners in short lists, and
  such a pair is let through with as many meetings less as both have long lists.
* Each group is one task, with the texts of its classes; a group with more than
  ``GROUP_SHINGLES`` shingles is cut into tiles, and every pair of tiles is a task.

Exactness: a pair that shares any long list is in that list's group if both are in
such groups; one that shares none is in a group of its own unless too rare a meeting
rules it out.  If either is in too few long lists x and y, at most min(x, y) of the l
common shingles have long lists, so the pair meets l - min(x, y) > 0 times in short ones.
A null, empty or word-less text has the empty set and is linked with nothing.
Rows with a null doc_id are in the result, alone in a component without id.
Repeated ids are one node per id: their rows' links all count.  An empty table
gives an empty result.  Only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rtree
from .common import staged
from .components import components
from .shingles import shingle_sets

HEAVY, TASK_HEAVY, SHORT = 200_000, 20_000, 16
LIST_ROWS, GROUP_SHINGLES = 500_000, 4_000_000
CHUNK_ROWS = 1_000_000


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The batch's sets, a few hundred texts at a time."""
    for at in range(0, batch.num_rows, 256):
        yield from shingle_sets(batch.column("text").slice(at, 256).to_pylist())


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def key_of(s: np.ndarray) -> tuple[int, int]:
    """128-bit key of a set, as two signed words."""
    key = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document doc_id, n, and a 128-bit key of its set; then the shingles that
    this task saw in several documents, with how many (lossy beyond TASK_HEAVY)."""
    heavy, count, pending, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
    names = ["doc_id", "n", "k1", "k2", "h"]
    for batch in batches:
        n, k1, k2 = [], [], []
        for s in _sets(batch):
            n.append(len(s))
            a, b = key_of(s)
            k1.append(a)
            k2.append(b)
            pending.append(s)
            held += len(s)
            if held > CHUNK_ROWS:
                heavy, count = _merged(heavy, count, pending)
                pending, held = [], 0
        nothing = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), nothing], names)
    heavy, count = _merged(heavy, count, pending)
    nothing = pa.nulls(len(heavy), pa.int64())
    yield pa.RecordBatch.from_arrays([nothing, pa.array(count), nothing, nothing, _i64(heavy)], names)


def _merged(heavy: np.ndarray, count: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
    new, n = new[n > 1], n[n > 1]
    every, back = np.unique(np.concatenate([heavy, new]), return_inverse=True)
    total = np.bincount(back, np.concatenate([count, n]), len(every)).astype(np.int64)
    if len(every) > TASK_HEAVY:
        keep = np.sort(np.argsort(-total, kind="stable")[:TASK_HEAVY])
        every, total = every[keep], total[keep]
    return every, total


def common_shingles(n: np.ndarray) -> np.ndarray:
    """l: so many of the listed shingles two linked sets have in common at least (of the smaller set)."""
    return 1 + n // 20


def fewest_common(n: np.ndarray) -> np.ndarray:
    """The least l of any set that one of n shingles may be linked with."""
    return common_shingles((3 * n + 3) // 4)


def listed(s: np.ndarray, heavy: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles a set is listed under, and which of them are known as heavy."""
    n = len(s)
    length = min(n, n // 4 + int(common_shingles(n)))
    at = np.minimum(np.searchsorted(heavy, s), max(0, len(heavy) - 1))
    is_heavy = heavy[at] == s if len(heavy) else np.zeros(n, bool)
    if not is_heavy.any():
        return s[:length], is_heavy[:length]
    rank = np.lexsort((s, np.where(is_heavy, count[at], 0)))[:length]
    return s[rank], is_heavy[rank]


def _lists(heavy: np.ndarray, count: np.ndarray, parts: int):
    """Rows (part, blob) with the listed shingles of many classes, by part of the hash
    range; rows (h, k) for shingles known as heavy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "blob", "h", "k"]
        keys, sizes, chunks, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(chunks)
            owner = np.repeat(np.arange(len(chunks), dtype=np.uint32), [len(c) for c in chunks])
            part = (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            order = np.lexsort((h, part))
            h, owner, part = h[order], owner[order], part[order]
            cut = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            all_keys, all_sizes = np.array(keys, "<i8"), np.array(sizes, "<u4")
            some, blobs = [p for p in range(parts) if cut[p + 1] > cut[p]], []
            for p in some:  # with the classes that this part has, not those of the whole chunk
                own, at = np.unique(owner[cut[p] : cut[p + 1]], return_inverse=True)
                head = np.array([len(own)], "<u4").tobytes() + all_keys[own].tobytes() + all_sizes[own].tobytes()
                blobs.append(head + h[cut[p] : cut[p + 1]].tobytes() + at.astype("<u4").tobytes())
            nothing = pa.nulls(len(some), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary()), nothing, nothing], names)

        for batch in batches:
            plain_h, plain_k = [], []
            for s in _sets(batch):
                if not len(s):
                    continue
                k = key_of(s)[0]
                mine, is_heavy = listed(s, heavy, count)
                if is_heavy.any():
                    plain_h.append(mine[is_heavy])
                    plain_k.append(np.full(is_heavy.sum(), k, np.int64))
                    mine = mine[~is_heavy]
                keys.append(k)
                sizes.append(len(s))
                chunks.append(mine)
                held += len(mine)
                if held > CHUNK_ROWS:
                    yield flush()
                    keys, sizes, chunks, held = [], [], [], 0
            if plain_h:
                h = np.concatenate(plain_h)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int32()), pa.nulls(len(h), pa.binary()), _i64(h), pa.array(np.concatenate(plain_k))], names)
        if held:
            yield flush()

    return run


def _opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = int(np.frombuffer(blob, "<u4", 1)[0])
    keys = np.frombuffer(blob, "<i8", m, 4)
    sizes = np.frombuffer(blob, "<u4", m, 4 + 8 * m)
    rows = (len(blob) - 4 - 12 * m) // 12
    h = np.frombuffer(blob, "<u8", rows, 4 + 12 * m)
    owner = np.frombuffer(blob, "<u4", rows, 4 + 12 * m + 8 * rows)
    return h, keys[owner], sizes[owner]


def _met(table: pa.Table) -> pa.Table:
    """One part of the hash range.  Rows (a, b, times, need, least) for pairs in short lists: linked
    if met ``need`` times, or ``least`` times with help of long lists.  Need and least null, a the
    group and times the number of its lists for members of long lists."""
    opened = [_opened(b.as_py()) for b in table.column("blob")]
    h, k, n = (np.concatenate(x) for x in zip(*opened, strict=True))
    order = np.lexsort((k, h))
    h, k, n = h[order], k[order], n[order].astype(np.int64)
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])  # copies of one class
    h, k, n = h[fresh], k[fresh], n[fresh]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    length = np.diff(np.append(first, len(h)))
    where = np.repeat(np.arange(len(first)), length)
    short = length[where] <= SHORT
    group = k[first][where]
    long_a, long_b = group[~short], k[~short]
    members, lists = np.unique(np.stack([long_a, long_b], 1), axis=0, return_counts=True) if len(long_a) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    pairs_a, pairs_b, needs, leasts = [], [], [], []
    for d in range(1, min(SHORT, len(h))):
        i = np.flatnonzero((where[d:] == where[:-d]) & short[d:])
        a, b = n[i], n[i + d]
        ok = i[4 * np.minimum(a, b) >= 3 * np.maximum(a, b)]
        pairs_a.append(k[ok])
        pairs_b.append(k[ok + d])
        needs.append(common_shingles(np.minimum(n[ok], n[ok + d])))
        leasts.append(needs[-1] + 1 - fewest_common(np.maximum(n[ok], n[ok + d])))
    a, b, need, least = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pairs_a, pairs_b, needs, leasts))
    order = np.lexsort((b, a))
    a, b, need, least = a[order], b[order], need[order], least[order]
    start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    times = np.diff(np.append(start, len(a)))
    columns = [
        pa.array(np.concatenate([a[start], members[:, 0]])), pa.array(np.concatenate([b[start], members[:, 1]])),
        pa.array(np.concatenate([times, lists])),
        *(pa.concat_arrays([pa.array(x[start]).cast(pa.int64()), pa.nulls(len(members), pa.int64())]) for x in (need, least)),
    ]
    return pa.table(columns, ["a", "b", "times", "need", "least"])


def _verified(table: pa.Table) -> pa.Table:
    """Links (a, b) among the classes of one group (or of two tiles of it)."""
    ids, sets, seen = [], [], set()
    own = shingle_sets(table.column("text").to_pylist())
    for rep, k, s in zip(table.column("rep").to_pylist(), table.column("k").to_pylist(), own, strict=True):
        if k not in seen and key_of(s)[0] == k:  # not another row with the same id
            seen.add(k)
            ids.append(rep)
            sets.append(s)
    found = rtree.links(sets) if len(sets) > 1 else []
    a = np.array([ids[i] for i, _ in found], np.int64)
    b = np.array([ids[j] for _, j in found], np.int64)
    return pa.table([pa.array(a), pa.array(b)], ["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every document; links at Jaccard 0.75 or more."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    survey = staged(docs.mapInArrow(_survey, "doc_id long, n long, k1 long, k2 long, h long"), "survey")
    heavy_rows = survey.filter("h is not null").groupBy("h").agg(F.sum("n").alias("c")).filter("c >= 8").orderBy(F.desc("c"), "h").limit(HEAVY).collect()
    heavy = np.array([r["h"] for r in heavy_rows], np.int64).view(np.uint64)
    count = np.array([r["c"] for r in heavy_rows], np.int64)
    order = np.argsort(heavy)
    heavy, count = heavy[order], count[order]
    own = survey.filter("h is null").drop("h")
    classes = staged(own.filter("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "classes")

    shingles = own.agg(F.sum("n")).first()[0] or 0
    parts = max(1, math.ceil(0.3 * shingles / LIST_ROWS))
    lists = staged(docs.mapInArrow(_lists(heavy, count, parts), "part int, blob binary, h long, k long"), "lists")
    met = lists.filter("part is not null").select("part", "blob").groupBy("part").applyInArrow(_met, "a long, b long, times long, need long, least long")
    met = staged(met, "met")
    known = lists.filter("h is not null").select("h", "k").distinct()
    first = known.groupBy("h").agg(F.min("k").alias("grp"), F.max("k").alias("_other")).filter("grp <> _other").drop("_other")
    in_long = met.filter("need is null").select(F.col("a").alias("grp"), F.col("b").alias("k"), "times")
    in_long = in_long.union(known.join(F.broadcast(first), "h").select("grp", "k", F.lit(1).cast("long")))  # at most HEAVY rows
    in_long = staged(in_long.groupBy("grp", "k").agg(F.sum("times").alias("times")), "long")
    shortest = classes.groupBy(F.col("k1").alias("k")).agg(F.min("n").alias("n"))  # one, but for classes of one key
    fewest = F.expr("1 + ((3 * n + 3) div 4) div 20")  # fewest_common
    long_of = in_long.groupBy("k").agg(F.sum("times").alias("long")).join(shortest, "k")
    long_of = staged(long_of.select("k", "long", (F.col("long") < fewest).alias("few")), "few")
    spread = in_long.join(long_of.filter("not few").select("k"), "k").select("grp", "k")
    met_often = met.filter("need is not null").groupBy("a", "b")
    met_often = met_often.agg(F.sum("times").alias("times"), F.max("need").alias("need"), F.min("least").alias("least")).filter("times >= least")
    for side in "ab":  # a class without long lists has no row: none, and so few
        own_long = long_of.select(F.col("k").alias(side), F.col("long").alias(f"long_{side}"), F.col("few").alias(f"few_{side}"))
        met_often = met_often.join(own_long, side, "left")
    helped = F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0)))
    few = F.coalesce("few_a", F.lit(True)) | F.coalesce("few_b", F.lit(True))
    pairs = met_often.filter(F.col("times") >= F.col("need") - F.when(few, helped).otherwise(0))
    members = pairs.select(F.col("a").alias("grp"), F.explode(F.array("a", "b")).alias("k")).union(spread).distinct()
    placed = staged(members.join(classes.select(F.col("k1").alias("k"), "rep", "n"), "k").select("grp", "k", "rep", "n"), "members")

    load = placed.groupBy("grp").agg(F.sum("n").alias("load"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    load = load.select("grp", F.ceil(F.col("load") / GROUP_SHINGLES).cast("int").alias("tiles"))
    tiled = placed.join(load, "grp").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    tiled = tiled.withColumn("_o", other).select("grp", "k", "rep", F.least("tile", "_o").alias("t1"), F.greatest("tile", "_o").alias("t2")).distinct()
    # texts are moved to the groups in the same way at every size: no broadcast of groups where they are few
    grouped = tiled.join(docs.hint("merge"), tiled["rep"] == docs["doc_id"]).select("grp", "t1", "t2", "k", "rep", "text")
    found = grouped.groupBy("grp", "t1", "t2").applyInArrow(_verified, "a long, b long")

    repeats = _repeats(own)
    same = own.filter("n > 0 and doc_id is not null").join(classes, ["k1", "k2", "n"])
    if repeats:  # rows of one id tie their classes together
        found = found.union(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b"))
    parts_of = components(found)
    named = same.join(parts_of, same["rep"] == parts_of["node"], "left")
    linked = named.select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"))
    alone = own.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.union(alone)
    if repeats:
        least = linked.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        out = out.drop("component_id").join(least, "doc_id", "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _repeats(own: DataFrame) -> bool:
    """Whether any id stands in several rows (one small aggregate over the staged survey)."""
    return bool(own.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count())
