"""Weighted minwise signatures by hierarchical Poisson processes (BagMinHash).

A bag gives value v the weight c (its count).  Think of the weight axis as cut into the
intervals [0,1), [1,2), [2,4), [4,8), ...  Each (value, interval) carries a Poisson process
in time whose rate is the interval's length; it is a function of value and interval alone,
so all documents see the same points.  A point falls on one of ``m`` signature slots and on
one place of its interval, found by halving it with fair coins (so an interval of length
2^k has integer cells).  A bag owns the points whose cell lies below c.  A slot's entry is
the bag's earliest point there.  Two bags agree in a slot with probability sum(min)/sum(max),
exactly: the unbiased weighted Jaccard.

Points are made in order of time, and only up to the time by which all slots are expected
to be full, m (ln m + 4) points a document whatever its length; documents with an empty
slot are continued.  At most ``_POINTS`` points are held at once, whatever the number of
documents and of values in one: processes are run through in slices, and a slot keeps its
earliest point so far.
"""

from __future__ import annotations

import numpy as np

from millrace.llm.textbytes import U64, mix

_POINTS = 1 << 18  # made at once; some twenty arrays of eight bytes each


def rows_at_once(m: int) -> int:
    """How many documents of few values make ``_POINTS`` points."""
    return max(1, int(_POINTS / (m * (np.log(m) + 4))))


def _expected(value_length, span, m):
    """Points to make at a time for processes of these lengths over these times; those that end early go on."""
    mean = m * value_length * span
    return np.ceil(mean + np.sqrt(mean) * (mean > 0.5)).astype(np.int64).clip(1)


def _slices(n: np.ndarray) -> list[tuple[int, int]]:
    """Runs of processes that make about ``_POINTS`` points, or one process alone."""
    end = np.cumsum(n)
    if not len(n) or end[-1] <= _POINTS:
        return [(0, len(n))]
    edge = np.unique(np.searchsorted(end, np.arange(_POINTS, end[-1], _POINTS), side="right").clip(1))
    at = [0, *edge.tolist(), len(n)]
    return [(a, b) for a, b in zip(at[:-1], at[1:]) if a < b]


def _points(value, interval, weight, row, until, m):
    """(row, slot, time, point) of processes up to each one's time ``until``."""
    length = np.where(interval == 0, 1, 1 << np.maximum(interval - 1, 0)).astype(float)
    seed = mix(value + interval.astype(U64) * U64(0xA24BAED4963EE407))
    clock = np.zeros(len(seed))
    made = np.zeros(len(seed), np.int64)
    live = np.arange(len(seed))
    out = []
    while len(live):
        n = _expected(length[live], until[live] - clock[live], m)
        who = np.repeat(np.arange(len(live)), n)
        begin = np.cumsum(n) - n
        turn = np.arange(len(who)) - begin[who]
        p = live[who]
        point = mix(seed[p] + (made[p] + turn + 1).astype(U64) * U64(0x9FB21C651E98DF25))
        gap = -np.log(((point >> U64(11)).astype(float) + 0.5) / float(1 << 53)) / (m * length[p])
        sums = np.cumsum(gap)
        time = clock[p] + sums - (sums[begin] - gap[begin])[who]
        early = time <= until[p]
        bits = mix(point ^ U64(0x5851F42D4C957F2D))
        cell = np.where(interval[p] == 0, 0, length[p].astype(np.int64) + (bits >> U64(20)).astype(np.int64) % np.maximum(length[p].astype(np.int64), 1))
        keep = early & (cell < weight[p])
        out.append((row[p[keep]], (bits % U64(m)).astype(np.int64)[keep], time[keep], point[keep]))
        last = begin + n - 1
        clock[live] = time[last]
        made[live] += n
        live = live[time[last] <= until[live]]
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, U64)]


def signatures(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """(n_rows, m) entries for bags in sorted (row, value, weight) form; rows without values get zeros."""
    top = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0)
    which = np.repeat(np.arange(len(row)), top + 1)
    interval = np.arange(len(which)) - (np.cumsum(top + 1) - (top + 1))[which]
    total = np.bincount(row, weight, n_rows)
    sig = np.zeros(n_rows * m, U64)
    best = np.full(n_rows * m, np.inf)
    span = (np.log(m) + 4) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        use = which[todo[row[which]]]
        cut = interval[todo[row[which]]]
        until = span[row[use]]
        for a, b in _slices(_expected(np.where(cut == 0, 1.0, np.exp2(cut - 1)), until, m)):
            one = use[a:b]
            r, slot, time, point = _points(value[one], cut[a:b], weight[one], row[one], until[a:b], m)
            at = r * m + slot
            np.minimum.at(best, at, time)
            won = time == best[at]
            sig[at[won]] = point[won]
        missing = np.isinf(best).reshape(n_rows, m).any(axis=1) & todo
        span[missing] *= 2
        todo = missing
    return sig.reshape(n_rows, m)


def bands(sig: np.ndarray, n: int, rows: int, seed: int = 7) -> np.ndarray:
    """(len(sig), n) hashes, as signed 64-bit integers, of ``n`` fixed choices of ``rows`` slots.

    The slots are shuffled and dealt out in runs, then shuffled anew, so all slots count alike.
    """
    rng = np.random.default_rng(seed)
    runs = sig.shape[1] // rows
    chosen = np.concatenate([rng.permutation(sig.shape[1])[: runs * rows].reshape(runs, rows) for _ in range(-(-n // runs))])[:n]
    total = np.zeros((len(sig), n), U64)
    for k in range(rows):
        total += mix(sig[:, chosen[:, k]] + U64(k + 1))
    return mix(total).astype(np.int64)
