"""Bit-sliced comparison of 64-bit fingerprints.

Fingerprints stand as bit planes, 64 lanes a word, so that one word operation updates
the distances of 64 of them. Differences are added up by carry-save adders into vertical
counters, and a block (one fingerprint against all lanes) is abandoned as soon as every
lane has passed the radius.
"""

from __future__ import annotations

import numpy as np

LANES = 2048  # fingerprints of small groups compared in one go
QUERIES = 64


def bit_planes(values: np.ndarray) -> np.ndarray:
    """planes[b]: bit b of every value, 64 lanes a word; lanes beyond the last value are zero."""
    lanes = -len(values) % 64
    bits = np.unpackbits(np.concatenate([values, np.zeros(lanes, dtype=np.uint64)]).view(np.uint8), bitorder="little").reshape(-1, 64)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _full_add(a, b, c):
    """Sum and carry bits of three words of lanes."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _seven(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bits of weight 1, 2 and 4 of the number of ones among seven planes."""
    s, first = _full_add(x[0], x[1], x[2])
    s, second = _full_add(s, x[3], x[4])
    s, third = _full_add(s, x[5], x[6])
    return (s, *_full_add(first, second, third))


#: Planes are added up one, then seven at a time.
STEPS = ((0, 1), *((b, b + 7) for b in range(1, 64, 7)))


def within_radius(values: np.ndarray, planes: np.ndarray, radius: int, done: np.ndarray | None = None, trace: list | None = None) -> np.ndarray:
    """For each value a row of words whose set lanes differ from it in ``radius`` bits at most.

    Each row is a block: its differences go, seven planes at a time, through a tree of
    carry-save adders into vertical counters, which start so that passing the radius
    overflows them into ``over``. A row whose lanes are all over is abandoned: the
    planes that are left are added up for the other rows only. ``done`` has lanes that
    need no comparison, such as the value itself. ``trace`` gets the number of live rows
    before each step.
    """
    if not 0 <= radius < 64:
        raise ValueError("the radius lies between 0 and 63 bits")
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    digits = radius.bit_length()
    over = np.zeros((len(values), planes.shape[1]), np.uint64) if done is None else done
    start = (1 << digits) - 1 - radius
    counter = [np.full(over.shape, full if start >> i & 1 else 0, np.uint64) for i in range(digits)]
    near = np.zeros(over.shape, np.uint64)
    rows = np.arange(len(values))
    for first, last in STEPS:
        live = (over != full).any(axis=1)
        if not live.all():
            rows, over, counter = rows[live], over[live], [c[live] for c in counter]
        if trace is not None:
            trace.append(len(rows))
        if not len(rows):
            return near
        bits = (values[rows][None, :] >> np.arange(first, last, dtype=np.uint64)[:, None]) & np.uint64(1)
        differ = planes[first:last, None, :] ^ (np.uint64(0) - bits)[:, :, None]
        number = _seven(differ) if last - first == 7 else (differ[0],)
        carry = np.zeros_like(over)
        for i, c in enumerate(counter):
            counter[i], carry = _full_add(c, number[i], carry) if i < len(number) else (c ^ carry, c & carry)
        over = over | carry
        for high in number[digits:]:
            over = over | high
    near[rows] = ~over
    return near


def _lanes_done(own: np.ndarray, first: int, last: int, ends: np.ndarray) -> np.ndarray:
    """Words in which the lanes are set that the values ``own`` need not meet: themselves, those before, other groups', and padding."""
    lane = np.arange(first, last)[None, :]
    return np.packbits((lane <= own[:, None]) | (lane >= ends[own][:, None]), axis=1, bitorder="little").view(np.uint64)


def near_pairs(values: np.ndarray, group: np.ndarray, radius: int, trace: list | None = None):
    """Pieces (first, last, x, y): pairs of places x < y of values of equal group within the radius, all from first up to last.

    ``group`` is sorted. Runs of small groups are compared together, a few queries at a
    time, and lanes of other groups count as done.
    """
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(values)]])
    start = 0
    for i in range(1, len(cuts)):
        last = i == len(cuts) - 1
        if not last and cuts[i + 1] - cuts[start] <= LANES:
            continue
        a, b = int(cuts[start]), int(cuts[i])
        planes = bit_planes(values[a:b])
        ends = np.repeat(cuts[start + 1 : i + 1], np.diff(cuts[start : i + 1])) - a
        start = i
        for q in range(0, b - a, QUERIES):
            own = np.arange(q, min(b - a, q + QUERIES))
            near = within_radius(values[a + own], planes[:, q // 64 :], radius, _lanes_done(own, q, 64 * planes.shape[1], ends), trace)
            x, y = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little"))
            yield a, b, a + q + x, a + q // 64 * 64 + y
