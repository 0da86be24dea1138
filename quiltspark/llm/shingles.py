"""64-bit hashes of the words of whole texts, and sets of hashed word shingles.

Words are hashed for many texts at once over their joined bytes: a byte stands
for a fixed random number, a word for their sum weighted by powers of an odd
number, which the difference of two running sums gives for every word alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LONG = 5
#: Texts are joined up to this many bytes (a longer one stands alone).
JOINED = 1 << 20
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_VALUE = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_POWERS: list[np.ndarray] = []


def finished(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words."""
    with np.errstate(over="ignore"):
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0x9FB21C651E98DF25)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(32))


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * JOINED)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, f, np.uint64)))) for f in (_STEP, _BACK)]
    return _POWERS


def hashed_words(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: the hashes of their words one after another, the words' last two
    bytes (of a word of one byte that and 0) as one number, and how many words each text has.  Words: A-Z lower-cased, cut
    at the six ASCII white-space bytes."""
    run, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        if run and size + len(raw) > JOINED:
            yield _hashed(run)
            run, size = [], 0
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield _hashed(run)


def _hashed(run: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n" + b"\n".join(run) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]  # the data begin and end with a space
    up, down = _powers(len(data))
    running = np.cumsum(_VALUE[data] * up[: len(data)])
    h = finished((running[end - 1] - running[start - 1]) * down[start] + (end - start).astype(np.uint64))
    tail = data[end - 1].astype(np.int64) + 256 * np.where(end - start > 1, data[end - 2], 0).astype(np.int64)
    bounds = np.cumsum([1] + [len(r) + 1 for r in run])
    return h, tail, np.diff(np.searchsorted(start, bounds))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its 5-word shingles; of a shorter text
    the one hash of all its words; of a text without words none."""
    out: list[np.ndarray] = []
    for w, _, counts in hashed_words(texts):
        many = max(0, len(w) - LONG + 1)
        total = w[:many] * _FACTORS[0]
        for j in range(1, LONG):
            total += w[j : j + many] * _FACTORS[j]
        total = finished(total)
        at = 0
        for n in counts.tolist():
            if n >= LONG:
                s = np.sort(total[at : at + n - LONG + 1])
                out.append(s if len(s) < 2 or (s[1:] != s[:-1]).all() else s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif n:
                out.append(finished(np.array([(w[at : at + n] * _FACTORS[:n]).sum() + np.uint64(n)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def shingle_set(text: str | None) -> np.ndarray:
    return shingle_sets([text])[0]
