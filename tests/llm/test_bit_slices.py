"""Bit-sliced comparison against plain distances, and the abandonment of blocks."""

import numpy as np
import pytest

from evispark.llm import bit_slices, near_copies, simhash


def some_values(n=300, seed=0):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2)
    values[100:200] = values[:100] ^ np.uint64(0b1011)
    return values


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 7, 10, 24, 40, 63])
def test_pairs_equal_plain_distances(radius):
    values = some_values()
    group = np.sort(np.random.default_rng(radius).integers(0, 5, len(values)))
    for groups in (group, np.zeros(len(values), np.int64)):
        near = np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius, 1)
        want = {(x, y) for x, y in zip(*(v.tolist() for v in np.nonzero(near))) if groups[x] == groups[y]}
        assert {(x, y) for _, _, xs, ys in bit_slices.near_pairs(values, groups, radius) for x, y in zip(xs.tolist(), ys.tolist())} == want


def test_radius_out_of_range_is_refused():
    values = some_values()
    with pytest.raises(ValueError):
        bit_slices.within_radius(values, bit_slices.bit_planes(values), 64)
    with pytest.raises(ValueError):
        simhash.near_links(None, radius=4)


def test_a_group_of_strangers_is_abandoned_early():
    values = np.random.default_rng(3).integers(0, 1 << 63, size=2048, dtype=np.uint64)
    live = []
    assert not any(len(x) for _, _, x, _ in bit_slices.near_pairs(values, np.zeros(2048, np.int64), 3, live))
    rows, steps = np.array(live), len(bit_slices.STEPS)
    assert len(rows) < steps * 2048 // bit_slices.QUERIES  # whole calls end before the last plane
    assert rows.sum() < 0.7 * steps * 2048


def test_hits_are_kept_while_others_are_abandoned():
    values = np.random.default_rng(4).integers(0, 1 << 63, size=640, dtype=np.uint64)
    values[600] = values[5] ^ np.uint64(1 << 62)
    live = []
    found = [(int(x), int(y)) for _, _, xs, ys in bit_slices.near_pairs(values, np.zeros(640, np.int64), 3, live) for x, y in zip(xs, ys)]
    assert found == [(5, 600)]
    assert live[len(bit_slices.STEPS) - 1] < bit_slices.QUERIES  # of the first queries, few reach the last planes


def test_similar_sets_lie_within_the_radius():
    rng = np.random.default_rng(1)
    for size in (5, 9, 40, 400):
        for _ in range(300):
            every = rng.integers(0, 1 << 63, size=size, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, size=size).astype(np.uint64)
            common = -(-4 * size // 5)
            half = (size - common) // 2
            a, b = np.concatenate([every[:common], every[common : common + half]]), np.concatenate([every[:common], every[common + half :]])
            assert bin((near_copies.majority(a) ^ near_copies.majority(b)) & (2**64 - 1)).count("1") <= near_copies.RADIUS
