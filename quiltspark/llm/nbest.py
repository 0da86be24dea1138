"""Operator 8: n-best segmentations over the piece lattice, and decoding.

The lattice of a text has an edge for every vocabulary piece that matches at a
place, weighted by the piece's score; a character that no piece covers has one
edge of its bytes, ``UNKNOWN_COST`` below the lowest score.  A forward pass
gives the best score from the start to every place.  A search from the end then
expands partial segmentations in order of (score so far + forward score): the
forward scores are exact, so segmentations come out in order, best first.

No piece of the vocabulary has a space mark after another character, so the
lattice falls apart at every such mark and a text's score is the sum over its
chunks.  A worker keeps each chunk's best segmentation and the distance to its
second best; the n best of a text only differ from its best in the n - 1 chunks
with the least distances (deviating anywhere else costs no less than n
segmentations already there), and only those are searched for more.

A null or empty text has one segmentation, of no pieces, with score 0.  Ties
are ordered by chunk and by the ids of the segmentation.  Texts with fewer
segmentations than asked for give all of them.  Repeated rows get equal
results; only the two named columns are read.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shingles import finished

UNKNOWN_COST = 10.0
CACHE_CHUNKS = 1_500_000
#: Parts up to this length are worked out many at a time.
TOGETHER = 24
#: Texts whose new chunks are worked out together.
TEXTS = 1024
_STEP = 0x9E3779B97F4A7C15
MARK = "▁"
ROW = (
    "doc_id long, n_pieces long, score double, ids binary, decoded string, "
    "others array<struct<score:double,n_pieces:bigint,changes:array<struct<at:bigint,out:bigint,ids:array<int>>>>>"
)

Way = tuple[float, tuple[int, ...]]


@lru_cache(4096)
def picks(lengths: tuple[int, ...], n: int) -> list[tuple[int, ...]]:
    """The mixes that may be among the n best: no more than n - 1 others are no worse in every chunk."""
    return [pick for pick in product(*map(range, lengths)) if prod(i + 1 for i in pick) <= n]


class Lattice:
    """The vocabulary as a lattice over texts that have been normalized."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_of: dict[int, int] | None, unknown: int):
        """pieces: text -> (id, score); bytes_of: byte -> id; unknown: the id without bytes."""
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has a space mark after another character")
        self.bytes_of, self.unknown = bytes_of or {}, unknown
        usual = [s for _, s in pieces.values() if s > -1e8]
        self.lowest = min(usual, default=0.0) - UNKNOWN_COST
        self.node: dict[str, tuple[int, float] | None] = {}
        for p in pieces:
            for k in range(1, len(p)):
                self.node.setdefault(p[:k], None)
        self.node.update(pieces)
        # the same as a tree: character -> (children, id or -1, score)
        self.tree, self.longest = self._tree(), max(map(len, pieces), default=1)
        self.inner = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.table = self._hash_table()
        self.known: dict[str, tuple[bytes, int, float, float]] = {}
        self.ways: dict[tuple[str, int], list[Way]] = {}

    def _tree(self) -> dict[str, tuple[dict, int, float]]:
        children: dict[str, dict] = {"": {}}
        for p in sorted(self.node, key=len):
            children[p] = {}
            found = self.node[p]
            children[p[:-1]][p[-1]] = (children[p], *(found or (-1, 0.0)))
        return children[""]

    def parts_of(self, chunk: str) -> tuple[str, ...]:
        """Signs at a chunk's end that stand beside their neighbour in no piece are parts
        of their own: no edge of the lattice crosses there."""
        inner, end = self.inner, len(chunk)
        while end > 1 and chunk[end - 2 : end] not in inner:
            end -= 1
        return (chunk[:end], *chunk[end:])

    def learn(self, chunks: set[str]) -> None:
        """Know the best segmentation of all these chunks."""
        known = self.known
        new = [c for c in chunks if c not in known]
        if len(known) + len(new) > CACHE_CHUNKS:
            known.clear()
            self.ways.clear()
            new = list(chunks)
        split = [self.parts_of(c) for c in new]
        parts: dict[str, tuple[bytes, int, float, float]] = {}
        by_length: dict[int, list[str]] = {}
        for part in {x for some in split for x in some}:
            if part in known:
                parts[part] = known[part]
            else:
                by_length.setdefault(len(part), []).append(part)
        for length, some in by_length.items():
            if length <= TOGETHER and len(some) >= 16:
                self._best_together(some, length, parts)
            else:
                for part in some:
                    parts[part] = self.best(part)
        for c, some in zip(new, split, strict=True):
            if len(some) == 1:
                known[c] = parts[c]
            else:
                blobs, counts, scores, gaps = zip(*[parts[x] for x in some], strict=True)
                known[c] = b"".join(blobs), sum(counts), sum(scores), min(gaps)

    def _hash_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces and their beginnings by hash: sorted hashes, ids (-1: only a beginning), scores."""
        rows = []
        for piece, found in self.node.items():
            h, (i, score) = 0, found or (-1, 0.0)
            for x in finished(np.array([ord(c) for c in piece], np.uint64)).tolist():
                h = (h * _STEP + x) & (1 << 64) - 1
            rows.append((h, i, score))
        rows.sort()
        return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])

    def _best_together(self, some: list[str], n: int, parts: dict[str, tuple[bytes, int, float, float]]) -> None:
        """``best`` of many parts of one length, a place of all of them at a time, into ``parts``."""
        hashes, ids_of, score_of = self.table
        m, rows = len(some), np.arange(len(some))
        value = finished(np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)).reshape(m, n)
        first, second = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        back, put = np.zeros((n + 1, m), np.int64), np.full((n + 1, m), -1, np.int64)
        first[0] = 0
        for i in range(n):
            h, alive = np.zeros(m, np.uint64), rows
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * np.uint64(_STEP) + value[alive, j - 1]
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[at] == h
                ids, edge = ids_of[at], score_of[at]
                if j == i + 1:  # a character that is no piece has an edge all the same
                    whole = hit & (ids >= 0)
                    self._pushed(first, second, back, put, i, j, rows, np.where(whole, edge, self.lowest), np.where(whole, ids, -1))
                else:
                    ends = np.flatnonzero(hit & (ids >= 0))
                    self._pushed(first, second, back, put, i, j, alive[ends], edge[ends], ids[ends])
                alive, h = alive[hit], h[hit]
                if not len(alive):
                    break
        at, steps, places = np.full(m, n), [], []
        while at.any():
            live = at > 0
            steps.append(np.where(live, put[at, rows], -2))
            at = np.where(live, back[at, rows], 0)
            places.append(at)
        found, places = np.stack(steps[::-1], 1), np.stack(places[::-1], 1)
        plain, ends = (~(found == -1).any(1)).tolist(), (4 * found.shape[1] * np.arange(1, m + 1)).tolist()
        starts = (4 * (found.shape[1] * np.arange(m) + (found == -2).sum(1))).tolist()
        flat, totals, gaps = found.astype("<u4").tobytes(), first[n].tolist(), (first[n] - second[n]).tolist()
        for k, part in enumerate(some):
            blob = flat[starts[k] : ends[k]]
            if not plain[k]:  # a character without a piece
                ids: list[int] = []
                for i, own in zip(places[k].tolist(), found[k].tolist(), strict=True):
                    if own != -2:
                        ids.extend((own,) if own >= 0 else self.unknown_ids(part[i]))
                blob = struct.pack(f"<{len(ids)}I", *ids)
            parts[part] = blob, len(blob) // 4, totals[k], gaps[k]

    @staticmethod
    def _pushed(first, second, back, put, i: int, j: int, rows: np.ndarray, edge: np.ndarray, ids: np.ndarray) -> None:
        """Edges from i to j of some rows, into the best and second-best scores at j."""
        s, other, a, b = first[i, rows] + edge, second[i, rows] + edge, first[j, rows], second[j, rows]
        better = s > a
        second[j, rows] = np.where(better, np.maximum(a, other), np.maximum(b, s))
        first[j, rows] = np.where(better, s, a)
        won = rows[better]
        back[j, won], put[j, won] = i, ids[better]

    def unknown_ids(self, char: str) -> tuple[int, ...]:
        got = tuple(self.bytes_of.get(b, -1) for b in char.encode("utf-8", "surrogatepass"))
        return got if got and -1 not in got else (self.unknown,)

    def edges(self, chunk: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For every end: (start, score, ids) of the edges that end there."""
        node, n = self.node, len(chunk)
        out: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            alone = False
            for j in range(i + 1, n + 1):
                part = chunk[i:j]
                if part not in node:
                    break
                found = node[part]
                if found:
                    out[j].append((i, found[1], (found[0],)))
                    alone = alone or j == i + 1
            if not alone:
                out[i + 1].append((i, self.lowest, self.unknown_ids(chunk[i])))
        return out

    def best(self, chunk: str) -> tuple[bytes, int, float, float]:
        """Best ids (little-endian u32), how many, their score, the distance to the second best."""
        root, n, worst = self.tree, len(chunk), -np.inf
        first, second, back = [worst] * (n + 1), [worst] * (n + 1), [(0, -1)] * (n + 1)
        first[0] = 0.0
        for i in range(n):
            here, other = first[i], second[i]
            alone = False
            below, j = root, i
            for char in chunk[i : i + self.longest]:
                found = below.get(char)
                if found is None:
                    break
                below, put, s = found
                j += 1
                if put < 0:
                    continue
                if j == i + 1:
                    alone = True
                s += here
                if s > first[j]:
                    second[j] = max(first[j], other + s - here)
                    first[j], back[j] = s, (i, put)
                elif s > second[j]:
                    second[j] = s
            if not alone:
                j, s = i + 1, here + self.lowest
                if s > first[j]:
                    second[j] = max(first[j], other + self.lowest)
                    first[j], back[j] = s, (i, -1)
                elif s > second[j]:
                    second[j] = s
        ids: list[int] = []
        j = n
        while j:
            j, put = back[j]
            if put >= 0:
                ids.append(put)
            else:
                ids.extend(reversed(self.unknown_ids(chunk[j])))
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids), len(ids), first[n], first[n] - second[n]

    def search(self, chunk: str, n: int) -> list[Way]:
        """The n best segmentations of a chunk, best first."""
        edges, end = self.edges(chunk), len(chunk)
        forward = [0.0] + [-np.inf] * end
        for j in range(1, end + 1):
            forward[j] = max(forward[i] + s for i, s, _ in edges[j])
        heap: list[tuple[float, tuple[int, ...], int, float]] = [(-forward[end], (), end, 0.0)]
        out: list[Way] = []
        while heap and len(out) < n:
            total, ids, j, behind = heapq.heappop(heap)
            if j == 0:
                out.append((-total, ids))
                continue
            for i, s, put in edges[j]:
                heapq.heappush(heap, (-(forward[i] + s + behind), put + ids, i, s + behind))
        return out

    def chunks(self, text: str) -> list[str]:
        """Cut before every space mark that follows another character."""
        parts = text.split(MARK)
        if "" not in parts[1:]:
            out = [MARK + p for p in parts]
            if parts[0]:
                out[0] = parts[0]
            else:
                del out[0]
            return out
        out, marks = [parts[0]] if parts[0] else [], ""
        for p in parts[1:]:
            marks += MARK
            if p:
                out.append(marks + p)
                marks = ""
        if marks:
            out.append(marks)
        return out

    def n_best(self, text: str, n: int) -> tuple[bytes, int, float, list[tuple[float, int, list[tuple[int, int, list[int]]]]]]:
        """Best ids, how many, score; then the others as (score, how many, changes),
        a change being (first id replaced, how many, the ids put there)."""
        return self.n_best_of(self.chunks(text), n)

    def n_best_of(self, chunks: list[str], n: int) -> tuple[bytes, int, float, list[tuple[float, int, list[tuple[int, int, list[int]]]]]]:
        """``n_best`` of a text that has been cut."""
        known = self.known
        if not chunks:
            return b"", 0, 0.0, []
        try:
            blobs, counts, scores, gaps = zip(*map(known.__getitem__, chunks), strict=True)
        except KeyError:
            self.learn(set(chunks))
            blobs, counts, scores, gaps = zip(*map(known.__getitem__, chunks), strict=True)
        ids, score, total = b"".join(blobs), sum(scores), sum(counts)
        if n < 2:
            return ids, total, score, []
        gap = np.array(gaps)
        if len(gap) >= n:
            close = np.flatnonzero(gap <= np.partition(gap, n - 2)[n - 2])
            close = close[np.argsort(gap[close], kind="stable")[: n - 1]]
        else:
            close = np.arange(len(gap))
        close = sorted(k for k in close.tolist() if np.isfinite(gap[k]))
        ways = []
        for k in close:
            key = (chunks[k], n)
            if key not in self.ways:
                own = (scores[k], struct.unpack(f"<{counts[k]}I", blobs[k]))
                # at equal scores the one that stands in ``ids`` comes first
                self.ways[key] = [own, *[w for w in self.search(*key) if w[1] != own[1]]][:n]
            ways.append(self.ways[key])
        mixes = sorted((-sum(w[i][0] for w, i in zip(ways, pick, strict=True)), pick) for pick in picks(tuple(map(len, ways)), n))
        starts = np.concatenate(([0], np.cumsum(counts)))
        base, others = sum(w[0][0] for w in ways), []
        for cost, pick in mixes[1:n]:
            changes = [(int(starts[k]), counts[k], list(w[i][1])) for k, w, i in zip(close, ways, pick, strict=True) if i]
            others.append((score - base - cost, total + sum(len(put) - out for _, out, put in changes), changes))
        return ids, total, score, others


class Codec:
    """A sentencepiece model file: its normalizer, lattice and decoder."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, bytes_of, self.text_of = {}, {}, []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                bytes_of[int(piece[3:5], 16)] = i
                self.text_of.append(bytes([int(piece[3:5], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i):
                self.text_of.append(b"")
            else:
                pieces[piece] = (i, self.model.get_score(i))
                self.text_of.append(piece.replace(MARK, " ").encode())
        self.lattice = Lattice(pieces, bytes_of, self.model.unk_id())

    def normalized(self, text: str) -> str:
        return self.model.normalize(text) if text else ""

    def decode(self, ids: bytes) -> str:
        """The text of ids (little-endian u32), without the space that normalizing puts first."""
        got = b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return got[1:] if got.startswith(" ") else got


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, n: int) -> DataFrame:
    """One row per document: the best segmentation's ids, score and decoded text, and
    the n - 1 next ones as changes to it (``applied`` gives their ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.string()]
        change = pa.struct([("at", pa.int64()), ("out", pa.int64()), ("ids", pa.list_(pa.int32()))])
        kinds.append(pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("changes", pa.list_(change))])))
        names = ["doc_id", "n_pieces", "score", "ids", "decoded", "others"]
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                rows: list[list] = [some.column("doc_id").to_pylist(), [], [], [], [], []]
                texts = [c.normalized(t or "") for t in some.column("text").to_pylist()]
                cut = [c.lattice.chunks(t) for t in texts]
                c.lattice.learn(set().union(*cut))
                for chunks in cut:
                    ids, total, score, others = c.lattice.n_best_of(chunks, n)
                    told = [
                        {"score": s, "n_pieces": m, "changes": [{"at": a, "out": o, "ids": put} for a, o, put in changes]}
                        for s, m, changes in others
                    ]
                    for column, value in zip(rows[1:], (total, score, ids, c.decode(ids), told), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, ROW)


def applied(ids: list[int], changes: list[tuple[int, int, list[int]]]) -> list[int]:
    """The ids of another segmentation: ``changes`` made to the best one."""
    out = list(ids)
    for at, gone, put in sorted(changes, reverse=True):
        out[at : at + gone] = put
    return out
