"""Operator 11: SimHash near-duplicates by pigeonring filtering.

A text's features are its 3-word shingles, repeats included, each hashed with
XXH64 (seed 42).  A bit of the 64-bit fingerprint is 1 if it is set in over half
of the hashes.  Two fingerprints are linked when at most ``TAU`` bits differ.

The bits form a ring of ``SEGMENTS`` equal segments.  If two fingerprints differ
in at most ``TAU`` bits, then from some segment on every chain of l consecutive
segments holds at most l * TAU / SEGMENTS differences (the cycle lemma), so:

* equal fingerprints are one class; each class is dealt once per segment, keyed
  by the segment's value: the chain's first quota (3/4 of a bit) is no difference;
* in a task the classes of one key are indexed by the next segment, and only
  runs that are equal there or differ by one bit meet (the quota of two);
* the quota of three segments prunes again before the whole distance is counted;
* a pair whose chain holds from several segments on is taken from the first.

A key with more than ``KEY_ROWS`` classes is cut finer: what the key leaves open
is split into ``TAU`` + 1 runs of bits, one of which must be equal, so its classes
are dealt once per run.  Each cut fixes more bits, and the open bits bound the
number of classes, so the cutting ends with every key small; no pair is lost.

A null, empty or word-less text has the fingerprint 0 and is linked like any
other; a text of one or two words has the hash of them all.  Rows without an id
are in the result, alone, without component; their texts count for nobody.
Repeated ids are one node: all their rows' links count.  Texts of any length are
read whole, a bounded number of hashes at a time.  An empty table gives an empty
result.  Only the two named columns are read, so no other name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged
from .components import components

WORDS, TAU, SEGMENTS, BITS = 3, 3, 4, 64
#: Classes of one key in a task, hashes and pairs held at a time, rows of keys to broadcast.
KEY_ROWS, HASHES, PAIRS, MANY_KEYS = 1 << 17, 1 << 18, 1 << 21, 100_000
_WIDTH = BITS // SEGMENTS
FULL = (1 << BITS) - 1
FOUND = "fp long, rep long, root long, n_links long"
LINKS = "fp_a long, fp_b long, rep_a long, rep_b long, distance int"


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of every 3-word shingle of one text, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII only, as bytes
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], 42) for a, b in zip(start[: 1 - WORDS].tolist(), end[WORDS - 1 :].tolist(), strict=True)])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(h), HASHES):
        bits = np.unpackbits(h[at : at + HASHES].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return total


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """One unsigned fingerprint per text."""
    out = np.zeros(len(texts), np.uint64)
    weight = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    held: list[np.ndarray] = []
    owner: list[int] = []
    n = 0

    def flush() -> None:
        h = np.concatenate(held)
        size = np.array([len(x) for x in held])
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count = np.add.reduceat(bits, np.concatenate(([0], np.cumsum(size)[:-1])), axis=0, dtype=np.int64)
        out[owner] = (2 * count > size[:, None]).astype(np.uint64) @ weight

    for k, text in enumerate(texts):
        h = shingle_hashes(text)
        if len(h) > HASHES:
            out[k] = ((2 * _bit_counts(h) > len(h)).astype(np.uint64) * weight).sum()
            continue
        if n + len(h) > HASHES:
            flush()
            held, owner, n = [], [], 0
        if len(h):
            held.append(h)
            owner.append(k)
            n += len(h)
    if held:
        flush()
    return out


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.concatenate([fingerprints(batch.column("text").slice(at, 1024).to_pylist()) for at in range(0, batch.num_rows, 1024)] or [np.zeros(0, np.uint64)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def segment(k: int) -> int:
    """The mask of the k-th segment of the ring."""
    return ((1 << _WIDTH) - 1) << (_WIDTH * (k % SEGMENTS))


def splits(start: int, fixed: int) -> list[int]:
    """The bits that ``fixed`` leaves open, in ring order from segment ``start``, as TAU + 1 masks."""
    ring = [(start * _WIDTH + b) % BITS for b in range(BITS)]
    free = [b for b in ring if not fixed >> b & 1]
    cut = [round(j * len(free) / (TAU + 1)) for j in range(TAU + 2)]
    return [sum(1 << b for b in free[a:z]) for a, z in zip(cut, cut[1:], strict=False)]


class Path:
    """How a key came about: the start segment, then which run of open bits was fixed at each cut."""

    def __init__(self, start: int, steps: tuple[int, ...] = ()):
        self.start, self.steps = start, steps
        self.fixed, self.earlier = segment(start), []
        for j in steps:
            runs = splits(start, self.fixed)
            self.earlier += runs[:j]  # a pair equal in one of these is found there
            self.fixed |= runs[j]

    @property
    def code(self) -> int:
        out = self.start
        for j in self.steps:
            out = out * (TAU + 1) + j
        return (len(self.steps) << 32) | out

    @classmethod
    def of(cls, code: int) -> Path:
        steps, rest = [], code & 0xFFFFFFFF
        for _ in range(code >> 32):
            rest, j = divmod(rest, TAU + 1)
            steps.append(j)
        return cls(rest, tuple(reversed(steps)))

    def children(self) -> list[Path]:
        return [Path(self.start, (*self.steps, j)) for j in range(TAU + 1)]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def chain_holds(x: np.ndarray, start: int) -> np.ndarray:
    """Whether differences ``x`` keep the quota of every chain that begins at ``start``."""
    ok, held = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for k in range(SEGMENTS):
        held += np.bitwise_count(x & np.uint64(segment(start + k)))
        ok &= held <= (k + 1) * TAU // SEGMENTS
    return ok


def _products(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (row, row) of matched runs, at most about PAIRS at a time.  Runs are given by first row and length."""
    size = n_left * n_right
    for k in np.flatnonzero(size > PAIRS).tolist():
        step = max(1, PAIRS // int(n_right[k]))
        other = right[k] + np.arange(n_right[k])
        for at in range(0, int(n_left[k]), step):
            some = left[k] + np.arange(at, min(at + step, int(n_left[k])))
            yield np.repeat(some, len(other)), np.tile(other, len(some))
    few = np.flatnonzero(size <= PAIRS)
    cuts = np.searchsorted(np.cumsum(size[few]), np.arange(PAIRS, size[few].sum() + PAIRS, PAIRS), side="right") if len(few) else []
    at = 0
    for cut in [*cuts, len(few)]:
        some = few[at : max(cut, at)]
        at = max(cut, at)
        if len(some):
            n = size[some]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(n_right[some], n)
            yield np.repeat(left[some], n) + within // wide, np.repeat(right[some], n) + within % wide


def pairs(fp: np.ndarray, key: np.ndarray, path: Path) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, distance) of linked pairs among the rows of each key of one path; every
    pair that has no earlier segment or run to be found by."""
    following = np.uint64(segment(path.start + 1))
    order = np.lexsort((fp & following, key))
    f, k = fp[order], key[order]
    # one code for (key, next segment): the key's number and the segment's value
    shift = np.uint64(_WIDTH * ((path.start + 1) % SEGMENTS))
    number = np.concatenate(([0], np.cumsum(k[1:] != k[:-1]))).astype(np.uint64)
    code = (number << np.uint64(_WIDTH)) | ((f & following) >> shift)
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    length, runs = np.diff(np.append(first, len(code))), code[first]
    for flip in [0, *(1 << b for b in range(_WIDTH))]:
        if flip:
            some = np.flatnonzero(runs & np.uint64(flip) == 0)  # each two runs meet once
            want = runs[some] | np.uint64(flip)
            at = np.minimum(np.searchsorted(runs, want), len(runs) - 1)
            hit = runs[at] == want
            some, at = some[hit], at[hit]
        else:
            some = at = np.flatnonzero(length > 1)
        for a, b in _products(first[some], length[some], first[at], length[at]):
            if not flip:
                a, b = a[a < b], b[a < b]
            x = f[a] ^ f[b]
            ok = chain_holds(x, path.start)
            for earlier in range(path.start):
                ok[ok] = ~chain_holds(x[ok], earlier)
            for mask in path.earlier:
                ok &= x & np.uint64(mask) != 0
            distance = np.bitwise_count(x[ok])
            yield order[a[ok]], order[b[ok]], distance


def _of_paths(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Linked rows of a task's table (path, key, fp, ...), as row numbers."""
    path = table.column("path").to_numpy()
    fp, key = (table.column(c).to_numpy().view(np.uint64) for c in ("fp", "key"))
    for code in np.unique(path).tolist():
        rows = np.flatnonzero(path == code)
        for a, b, d in pairs(fp[rows], key[rows], Path.of(code)):
            yield rows[a], rows[b], d


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each item's smallest known fellow) after joining a[k] with b[k]."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _joined(table: pa.Table) -> pa.Table:
    """Per class with links in this table: fp, rep, the least linked rep here, and how many rows it is linked to."""
    fp, row = np.unique(table.column("fp").to_numpy(), return_inverse=True)
    rep, n = np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64)
    rep[row], n[row] = table.column("rep").to_numpy(), table.column("n").to_numpy()
    label, links = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    for a, b, _ in _of_paths(table):
        a, b = row[a], row[b]
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        label = merge(label, a, b)
    some = np.flatnonzero(links)
    return pa.table([pa.array(x) for x in (fp[some], rep[some], rep[label[some]], links[some])], ["fp", "rep", "root", "n_links"])


def _listed(table: pa.Table) -> pa.Table:
    fp, rep = table.column("fp").to_numpy(), table.column("rep").to_numpy()
    found = [(a, b, d) for a, b, d in _of_paths(table) if len(a)]
    a, b, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    return pa.table([pa.array(fp[a]), pa.array(fp[b]), pa.array(rep[a]), pa.array(rep[b]), pa.array(d.astype(np.int32))], ["fp_a", "fp_b", "rep_a", "rep_b", "distance"])


def _paths(spark: SparkSession, paths: list[Path]) -> Column:
    """(path, key) for each of ``paths`` that lead on from the column ``path``'s value."""
    return F.array(*[F.struct(F.lit(p.code).alias("path"), F.col("fp").bitwiseAND(F.lit(signed(p.fixed))).alias("key")) for p in paths])


def keyed(classes: DataFrame) -> DataFrame:
    """The classes (fp, rep, n) under every key that a linked pair may share, no key
    with more than KEY_ROWS of them: path, key, fp, rep, n."""
    spark = classes.sparkSession
    level = [Path(k) for k in range(SEGMENTS)]
    rows = classes.select(F.inline(_paths(spark, level)), "fp", "rep", "n")
    done = None
    while True:
        large = staged(rows.groupBy("path", "key").count().filter(F.col("count") > KEY_ROWS).select("path", "key"), "keys")
        some = large.count()
        if not some:
            return rows if done is None else done.unionByName(rows)
        large = F.broadcast(large) if some <= MANY_KEYS else large
        small = rows.join(large, ["path", "key"], "left_anti").select(rows.columns)
        done = small if done is None else done.unionByName(small)
        of = {p.code: p.children() for p in level}
        codes = {r["path"] for r in large.select("path").distinct().collect()}  # at most 4 ** (cuts + 1)
        again = rows.join(large, ["path", "key"], "left_semi")
        parts = [again.filter(F.col("path") == c).select(F.inline(_paths(spark, of[c])), "fp", "rep", "n") for c in sorted(codes)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rows = staged(rows, "finer")
        level = [p for c in codes for p in of[c]]


def _grouped(classes: DataFrame):
    rows = keyed(classes)
    spark = classes.sparkSession
    parts = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-SEGMENTS * classes.count() // KEY_ROWS))
    return rows.withColumn("part", F.pmod(F.xxhash64("path", "key"), F.lit(parts))).groupBy("part")


def _survey(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's fingerprint, and the classes of equal ones: fp, rep (least id), n (rows)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = staged(rows.mapInArrow(_printed, "doc_id long, fp long"), "fingerprints")
    classes = own.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    return own, staged(classes, "classes")


def links(docs: DataFrame) -> DataFrame:
    """Every linked pair of unequal fingerprints, once: fp_a, fp_b, rep_a, rep_b (the least
    ids with them), distance.  Rows of equal fingerprints are linked without being listed."""
    return _grouped(_survey(docs)[1]).applyInArrow(_listed, LINKS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_links (other rows linked to this one)."""
    own, classes = _survey(docs)
    found = staged(_grouped(classes).applyInArrow(_joined, FOUND), "joined")
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b")).filter("a <> b")
    if own.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        tied = own.filter("doc_id is not null").join(classes.select("fp", "rep"), "fp")
        edges = edges.union(tied.select("doc_id", "rep").filter("doc_id <> rep"))
    parts = components(edges)
    linked = found.groupBy("fp").agg(F.sum("n_links").alias("n_links"))
    known = classes.join(linked, "fp", "left").join(parts, F.col("rep") == F.col("node"), "left")
    known = known.select("fp", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    named = own.filter("doc_id is not null").join(known, "fp").select("doc_id", "fp", "component_id", "n_links")
    nobody = own.filter("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return named.union(nobody).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
