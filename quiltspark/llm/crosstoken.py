"""Operator 12: cross-tokenizer alignment by diagonal run skipping.

Both tokenizers cut the same bytes; a token is known by where it ends.  ``align``
walks both lists of ends on one diagonal, the current index shift.  While ends
agree it compares stretches of doubled length at that shift and jumps over all
that is one to one; a stretch that fails is halved until the first unequal ends
are found.  There the group is resolved locally, by advancing the side that is
behind until both end at the same byte, and the shift becomes what it is there.

Both tokenizers begin a token at every single space, so what two spaces enclose
is encoded and aligned once per worker (many new ones at a time, as one pair of
lists) and known from then on; at most ``CACHE_WORDS``, then a worker starts
afresh.  Texts with white space at an end or beside a space, and texts with a
word that the pieces don't give back, are encoded and aligned whole.

The number of documents that hold an id pair linked is summed in Spark from each
task's sums; what a document then looks up is sent to the workers in slices of at
most ``SLICE`` pairs, one pass of the stored pairs for each slice.

Texts that are null, empty, or that either tokenizer doesn't give back byte for
byte have no tokens: zeros, and an empty digest.  Special tokens' strings are
plain text.  Rows that repeat an id are documents of their own.  Texts of any
length are read whole.  An empty table gives an empty result.  Only the two
named columns are read, so other names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

CACHE_WORDS, SLICE, HELD_PAIRS = 500_000, 2_000_000, 2_000_000
MARK = "▁"
_BESIDE = re.compile(r"\s | \s")
_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "pair", "docs"]
SURVEY = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, pair long, docs long"
_CODERS: dict[tuple[str, str], Coder] = {}


def align(a: Sequence[int], b: Sequence[int]) -> tuple[list[int], list[int]]:
    """For each group, how many tokens of ``a`` and of ``b`` end with it or before.

    ``a``, ``b``: rising byte ends of the two tokenizations, the last ones equal."""
    if (a[-1] if a else 0) != (b[-1] if b else 0):
        raise ValueError("the tokenizations do not end at the same byte")
    cut_a: list[int] = []
    cut_b: list[int] = []
    n, i, shift = len(a), 0, 0
    while i < n:
        if a[i] == b[i + shift]:
            start, step = i, 1
            while i + step <= n and a[i : i + step] == b[i + shift : i + shift + step]:
                i += step
                step *= 2
            while step > 1:
                step //= 2
                if i + step <= n and a[i : i + step] == b[i + shift : i + shift + step]:
                    i += step
            cut_a.extend(range(start + 1, i + 1))
            cut_b.extend(range(start + 1 + shift, i + 1 + shift))
            continue
        j = i + shift
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        shift = j - i
        cut_a.append(i)
        cut_b.append(j)
    return cut_a, cut_b


def byte_values() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones as themselves,
    the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Coder:
    """Both tokenizers of a worker, and what it knows of single words."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_values()
        entries = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.bytes_a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has a space mark after another character")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.long_a, self.long_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.n_b = len(pieces)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.counts = np.zeros((1024, 3), np.int64)  # tokens of a, of b, groups
        self.start = np.zeros(1025, np.int64)
        self.flat = np.zeros(8192, np.int64)  # all words' linked id pairs, one word after the other
        self.texts: list[bytes] = []

    def keep(self, words: list[str], counts: np.ndarray, sizes: np.ndarray, pairs: np.ndarray, texts: list[bytes]) -> None:
        at, n = len(self.texts), len(words)
        while at + n > len(self.counts):
            self.counts = np.concatenate((self.counts, np.zeros_like(self.counts)))
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
        end = int(self.start[at])
        while end + len(pairs) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.counts[at : at + n] = counts
        self.start[at + 1 : at + n + 1] = end + np.cumsum(sizes)
        self.flat[end : end + len(pairs)] = pairs
        self.texts += texts
        self.known.update(zip(words, range(at, at + n), strict=True))

    def ids_a(self, text: str) -> list[int]:
        return self.a.encode(text, add_special_tokens=False).ids

    def same_bytes(self, ids_a: list[int], ids_b: list[int], raw: bytes) -> bool:
        return b"".join([self.bytes_a[i] for i in ids_a]) == raw and b"".join([self.bytes_b[i] for i in ids_b]) == raw

    def aligned(self, ids_a: list[int], ids_b: list[int], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of equal bytes cut into parts that end at ``ends``, per part: counts, how many links,
        all links (id pairs, in order), and its groups as text."""
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        end_a, end_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        cut_a, cut_b = align(end_a.tolist(), end_b.tolist())
        # a group of p and q tokens has p + q - 1 overlaps: one at each byte where either ends
        every = np.union1d(end_a, end_b)
        pairs = a[np.searchsorted(end_a, every)] * self.n_b + b[np.searchsorted(end_b, every)]
        groups = np.searchsorted(end_a[np.array(cut_a) - 1], ends, side="right")
        until = [np.searchsorted(x, ends, side="right") for x in (end_a, end_b)]
        counts = np.diff(np.stack([*until, groups]), axis=1, prepend=0).T
        sizes = np.diff(np.searchsorted(every, ends, side="right"), prepend=0)
        sa, sb = list(map(str, ids_a)), list(map(str, ids_b))
        shown, i, j = [], 0, 0
        for x, y in zip(cut_a, cut_b, strict=True):
            shown.append(f"{sa[i]}|{sb[j]}" if x - i == 1 == y - j else f"{','.join(sa[i:x])}|{','.join(sb[j:y])}")
            i, j = x, y
        cuts = [0, *groups.tolist()]
        return counts, sizes, pairs, [";".join(shown[p:q]).encode() for p, q in zip(cuts, cuts[1:], strict=False)]

    def learn(self, words: set[str]) -> None:
        """Know these words, each as it stands after one space."""
        new = [w for w in words if w not in self.known]
        if len(self.texts) + len(new) > CACHE_WORDS:
            self.clear()
            new = list(words)
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            raw = [b" " + w.encode() for w in some]
            each_b = self.b.encode(some, num_threads=1)
            fine = [b"".join([self.bytes_b[i] for i in ids]) == r for ids, r in zip(each_b, raw, strict=True)]
            bad = [w for w, ok in zip(some, fine, strict=True) if not ok]
            good = [k for k, ok in enumerate(fine) if ok]
            ids_a = self.ids_a("".join([f" {some[k]}" for k in good])) if good else []
            if b"".join([self.bytes_a[i] for i in ids_a]) != b"".join([raw[k] for k in good]):
                bad, good = some, []
            if good:
                ids_b = [i for k in good for i in each_b[k]]
                self.keep([some[k] for k in good], *self.aligned(ids_a, ids_b, np.cumsum([len(raw[k]) for k in good])))
            self.known.update(dict.fromkeys(bad, -1))

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray, bytes] | None:
        """Counts, links and groups of one text; None if a tokenizer doesn't give it back."""
        ids_a, ids_b, raw = self.ids_a(f" {text}"), self.b.encode(text), f" {text}".encode()
        if not text or not self.same_bytes(ids_a, ids_b, raw):
            return None
        counts, _, pairs, texts = self.aligned(ids_a, ids_b, np.array([len(raw)]))
        return counts[0], pairs, texts[0]

    def some(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes] | None]:
        """Of each text its counts, its links (one by one) and its groups; None if it has no tokens."""
        split = [t.split(" ") if t and not (t[0].isspace() or t[-1].isspace() or _BESIDE.search(t)) else None for t in texts]
        self.learn(set().union(*[w for w in split if w]))
        for text, words in zip(texts, split, strict=True):
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) if words else None
            if not text:
                yield None
            elif at is None or at.min() < 0:
                yield self.whole(text)
            else:
                first = self.start[at]
                size = self.start[at + 1] - first
                where = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
                yield self.counts[at].sum(0), self.flat[where], b";".join([self.texts[k] for k in at.tolist()])


def coder(path_a: str, path_b: str) -> Coder:
    """One per worker process and pair of files."""
    if (path_a, path_b) not in _CODERS:
        _CODERS[path_a, path_b] = Coder(path_a, path_b)
    return _CODERS[path_a, path_b]


def _surveyor(path_a: str, path_b: str):
    """Rows of documents, with their distinct linked pairs and how often each; then rows
    (pair, docs) with this task's document counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path_a, path_b)
        pairs, docs, pending, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(pending) if pending else pairs[:0], return_counts=True)
            every, back = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, back, np.concatenate([docs, n]))
            return every, total

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, digests, blobs, times = [], [], [], []
                for found in code.some(part.column("text").to_pylist()):
                    if found is None:
                        rows.append((0, 0, 0, 0))
                        digests.append("")
                        blobs.append(b"")
                        times.append(b"")
                        continue
                    counts, links, groups = found
                    distinct, n = np.unique(links, return_counts=True)
                    rows.append((*counts.tolist(), len(links)))
                    digests.append(hashlib.sha256(groups).hexdigest())
                    blobs.append(distinct.astype("<u4").tobytes())
                    times.append(n.astype("<u4").tobytes())
                    pending.append(distinct)
                    held += len(distinct)
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                nothing = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, pa.array(digests), pa.array(blobs, pa.binary()), pa.array(times, pa.binary()), nothing, nothing], _COLUMNS)
                if held > HELD_PAIRS:
                    (pairs, docs), pending, held = merged(), [], 0
        pairs, docs = merged()
        n = len(pairs)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * 5, pa.nulls(n, pa.string()), *[pa.nulls(n, pa.binary())] * 2, pa.array(pairs), pa.array(docs)], _COLUMNS)

    return run


def pair_counts(survey: DataFrame, n_b: int) -> DataFrame:
    """pair (A id * n_b + B id), docs (documents that hold it linked), best (no pair of its A id has more)."""
    counts = survey.filter("pair is not null").groupBy("pair").agg(F.sum("docs").alias("docs"))
    a = F.floor(F.col("pair") / n_b)
    highest = counts.groupBy(a.alias("_a")).agg(F.max("docs").alias("_most"))
    joined = counts.withColumn("_a", a).join(F.broadcast(highest), "_a")  # no more rows than A has ids
    return joined.select("pair", "docs", (F.col("docs") == F.col("_most")).alias("best"))


def _rater(shared):
    """Adds to each row what its pairs of one slice give: n_best, count_sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, best = shared.value
        for batch in batches:
            blobs = batch.column("pairs").to_pylist()
            mine = np.frombuffer(b"".join(blobs), "<u4").astype(np.int64)
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4").astype(np.int64)
            size = np.array([len(x) // 4 for x in blobs], np.int64)
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            hit = keys[at] == mine
            totals = []
            for name, value in (("n_best", best), ("count_sum", docs)):
                running = np.concatenate(([0], np.cumsum(np.where(hit, value[at] * times, 0))))
                ends = np.cumsum(size)
                totals.append(batch.column(name).to_numpy() + running[ends] - running[ends - size])
            rest = [n for n in batch.schema.names if n not in ("n_best", "count_sum")]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in rest] + [pa.array(t) for t in totals], [*rest, "n_best", "count_sum"])

    return run


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and ``pairs``, ``times``:
    the distinct linked pairs (A id * size of B + B id, rising) and how often each, as little-endian u32."""
    spark = docs.sparkSession
    code = coder(path_a, path_b)
    if len(code.bytes_a) * code.n_b >= 1 << 32:
        raise ValueError("the vocabularies have too many id pairs for 32 bits")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = staged(rows.mapInArrow(_surveyor(path_a, path_b), SURVEY), "aligned")
    counts = staged(pair_counts(survey, code.n_b), "pairs")
    slices = max(1, math.ceil(counts.count() / SLICE))
    zero = F.lit(0).cast("long")
    out = survey.filter("pair is null").select(*_COLUMNS[:-2], zero.alias("n_best"), zero.alias("count_sum"))
    for k in range(slices):
        part = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(slices)) == k).orderBy("pair").toArrow()
        if part.num_rows:
            shared = spark.sparkContext.broadcast((part.column("pair").to_numpy(), part.column("docs").to_numpy(), part.column("best").to_numpy().astype(np.int64)))
            out = out.mapInArrow(_rater(shared), out.schema)
    return out
