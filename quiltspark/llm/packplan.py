"""Packing plan over a histogram of piece lengths: linear grouping, few-size
configurations, substitution, best fit.  Its size depends on the capacity, not
on the number of pieces, so it is made once on the driver."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np

#: length, first rank, pieces, first sequence, pieces per sequence, offset of the first one
Run = tuple[int, int, int, int, int, int]


def best_configuration(worth: np.ndarray, sizes: np.ndarray, cap: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within ``cap`` of the greatest total worth."""
    value, used = np.zeros(cap + 1), np.zeros((len(sizes), cap + 1), np.int64)
    for g, (size, w) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
        if w <= 0:
            continue
        best = value.copy()
        for n in range(1, cap // size + 1):
            gain, at = value[: cap + 1 - n * size] + n * w, slice(n * size, None)
            better = gain > best[at] + 1e-12
            best[at][better] = gain[better]
            used[g, at][better] = n
        value = best
    found, room = np.zeros(len(sizes)), cap
    for g in range(len(sizes) - 1, -1, -1):
        found[g] = used[g, room]
        room -= int(found[g]) * int(sizes[g])
    return float(value[cap]), found


def configurations(sizes: np.ndarray, demand: np.ndarray, cap: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations and how many sequences use each, from the linear programme
    over all configurations (columns are priced as they are needed), rounded
    down; what rounding leaves over goes to best fit."""
    k = len(sizes)
    basis = np.diag((cap // sizes).astype(float))
    for _ in range(rounds):
        amount = np.linalg.solve(basis, demand)
        price = np.linalg.solve(basis.T, np.ones(k))
        worth, column = best_configuration(price, sizes, cap)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    amount = np.linalg.solve(basis, demand)
    return [(basis[:, j].astype(int), int(amount[j] + 1e-6)) for j in range(k) if amount[j] >= 1 - 1e-6]


class Queue:
    """Pieces of one group, longest first, as runs of (length, first rank, count)."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        self.runs = runs[::-1]
        self.left = sum(n for _, _, n in runs)

    def take(self, n: int) -> list[tuple[int, int, int]]:
        out = []
        while n and self.runs:
            length, rank, have = self.runs.pop()
            use = min(n, have)
            out.append((length, rank, use))
            if have > use:
                self.runs.append((length, rank + use, have - use))
            n -= use
            self.left -= use
        return out


def grouped(hist: list[tuple[int, int]], groups: int) -> list[Queue]:
    """Groups of equal cardinality over the lengths, longest first."""
    total = sum(n for _, n in hist)
    per, whole = max(1, -(-total // groups)), Queue([(length, 0, n) for length, n in sorted(hist, reverse=True)])
    out = []
    while whole.left:
        out.append(Queue(whole.take(per)))
    return out


class Rooms:
    """Open sequences by the room left in them: room -> [(first sequence, how many)]."""

    def __init__(self) -> None:
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.sorted: list[int] = []

    def add(self, room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in self.by:
                self.by[room] = []
                insort(self.sorted, room)
            self.by[room].append((first, n))

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        at = bisect_left(self.sorted, length)
        if at == len(self.sorted):
            return None
        room = self.sorted[at]
        first, n = self.by[room].pop()
        if not self.by[room]:
            del self.by[room]
            self.sorted.pop(at)
        return room, first, n


def filled(hist: dict[int, int], cap: int, small: float, groups: int) -> tuple[list[tuple[list[tuple[int, int]], int]], list[tuple[int, int, int]]]:
    """Configured sequences after substitution, as ([(length, first rank)], how many
    alike in a row), and the large pieces that rounding down left over."""
    large = [(length, n) for length, n in hist.items() if n and small * cap < length < cap]
    by_size: dict[int, list[Queue]] = {}
    for q in grouped(large, groups):
        by_size.setdefault(q.runs[-1][0], []).append(q)
    sizes = np.array(sorted(by_size, reverse=True), np.int64)
    queues = [Queue([run for q in by_size[s] for run in q.runs[::-1]]) for s in sizes]
    out = []
    for column, bins in configurations(sizes, np.array([float(q.left) for q in queues]), cap) if large else []:
        slots = [queues[g].take(bins) for g in range(len(sizes)) for _ in range(column[g])]
        ends = {0, bins}
        for runs in slots:
            ends.update(np.cumsum([n for _, _, n in runs]).tolist())
        cuts = sorted(ends)
        for a, b in zip(cuts, cuts[1:], strict=False):
            held = []
            for runs in slots:
                at = 0
                for length, rank, n in runs:
                    if at <= a < at + n:
                        held.append((length, rank + a - at))
                    at += n
            out.append((held, b - a))
    return out, [run for q in queues for run in q.take(q.left)]


def placed(hist: dict[int, int], cap: int, small: float, configured: list, left: list, slack: int) -> tuple[int, list[Run]]:
    """Sequences used and all places.  A configured sequence whose actual pieces
    leave more than ``slack`` unused is opened again and its pieces go to best fit."""
    out: list[Run] = []
    rooms, following = Rooms(), 0
    if hist.get(cap):
        out.append((cap, 0, hist[cap], 0, 1, 0))
        following = hist[cap]
    rest = left + [(length, 0, n) for length, n in hist.items() if n and length <= small * cap and length < cap]
    for held, n in configured:
        used = 0
        if cap - sum(length for length, _ in held) > slack:
            rest += [(length, rank, n) for length, rank in held]
            continue
        for length, rank in held:
            out.append((length, rank, n, following, 1, used))
            used += length
        rooms.add(cap - used, following, n)
        following += n
    for length, rank, n in sorted(rest, reverse=True):
        while n:
            room, first, bins = rooms.tightest(length) or (cap, following, -(-n // (cap // length)))
            following = max(following, first + bins)
            each = room // length
            full = min(bins, n // each)
            if full:
                out.append((length, rank, full * each, first, each, cap - room))
                rooms.add(room - each * length, first, full)
                rank, n = rank + full * each, n - full * each
            if n and full < bins:
                out.append((length, rank, n, first + full, each, cap - room))
                rooms.add(room - n * length, first + full, 1)
                rank, n, full = rank + n, 0, full + 1
            rooms.add(room, first + full, bins - full)
    return following, out


def plan(hist: dict[int, int], cap: int, small: float = 1 / 8, groups: tuple[int, ...] = (32, 96), slacks: tuple[float, ...] = (1, 1 / 16, 1 / 32, 1 / 64, 1 / 256, 0)) -> list[Run]:
    """Places for all pieces of the histogram {length: count}; lengths are 1 to ``cap``.

    Pieces longer than ``small * cap`` are split into groups of equal
    cardinality; all of a group count as its longest.  The configurations found
    for these few sizes are filled with the actual pieces.  Pieces that rounding
    left over, then the small ones, go by decreasing length into the sequence
    with the least sufficient room, which also uses what rounding up wasted.
    Where small pieces are too few to use it up, configured sequences that waste
    more than a slack (a share of ``cap``) are given to best fit as well; of the
    ``groups`` and ``slacks`` those with the fewest sequences hold, at a tie the first."""
    tried = []
    for g in groups:
        configured, left = filled(hist, cap, small, g)
        tried += [placed(hist, cap, small, configured, left, int(x * cap)) for x in slacks]
    return min(tried, key=lambda t: t[0])[1]
