"""Clusters by density against a plain rewrite, and what they tell apart."""

import itertools
import math
import random

import pytest

from pathloom.operators.density import cluster_by_density, components

SCHEMA = "id int, vector array<double>, kept string"


def plain(points, size, least):
    """The rule once more, in memory: point id to cluster."""
    cell = {i: tuple(math.floor(x / size) for x in v) for i, v in points}
    count = {}
    for c in cell.values():
        count[c] = count.get(c, 0) + 1

    def ring(c):
        return (tuple(a + d for a, d in zip(c, step)) for step in itertools.product((-1, 0, 1), repeat=len(c)))

    near = {c: sum(count.get(o, 0) for o in ring(c)) for c in count}
    dense = {c for c in count if near[c] >= least}
    root = {c: c for c in dense}
    changed = True
    while changed:
        changed = False
        for c in dense:
            low = min(root[o] for o in ring(c) if o in dense)
            if low < root[c]:
                root[c], changed = low, True
    for c in set(count) - dense:
        beside = [o for o in ring(c) if o in dense]
        if beside:
            root[c] = root[max(beside, key=lambda o: (near[o], o))]
    size_of = {}
    for c, r in root.items():
        size_of[r] = size_of.get(r, 0) + count[c]
    order = sorted(size_of, key=lambda r: (-size_of[r], r))
    return {i: order.index(root[c]) if c in root else -1 for i, c in cell.items()}


def ring_and_blobs(seed, dims):
    r = random.Random(seed)
    out = [[5 + r.gauss(0, 0.3) for _ in range(dims)] for _ in range(120)] + [[-5 + r.gauss(0, 0.2) for _ in range(dims)] for _ in range(60)]
    out += [[r.uniform(-20, 20) for _ in range(dims)] for _ in range(40)]
    if dims == 2:  # a closed ring is one cluster, however long the way around
        out += [[15 * math.cos(a / 50), 15 * math.sin(a / 50)] for a in range(315) for _ in range(2)]
    return list(enumerate(out))


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_against_a_plain_rewrite(spark, dims):
    points = ring_and_blobs(dims, dims)
    points += [(1_000 + i, v) for i, v in points[:30]]
    df = spark.createDataFrame([(i, v, "k") for i, v in points], SCHEMA).repartition(5)
    got = {r["id"]: r for r in cluster_by_density(df, 0.8, 6).collect()}
    want = plain(points, 0.8, 6)
    assert {i: r["cluster"] for i, r in got.items()} == want
    assert all((r["probability"] == 0) == (r["cluster"] == -1) and r["probability"] <= 1 and r["kept"] == "k" for r in got.values())


def test_two_groups_and_scattered_points(spark):
    r = random.Random(4)
    groups = [(i, [r.gauss(0, 0.1), r.gauss(0, 0.1)], None) for i in range(900)] + [(900 + i, [10 + r.gauss(0, 0.1), 0.0], None) for i in range(80)]
    lonely = [(2_000 + i, [30.0 + 7 * i, -40.0], None) for i in range(20)]
    odd = [(3_000, None, None), (3_001, [float("nan"), 1.0], None), (3_002, [None, 1.0], None), (3_003, [float("inf"), 0.0], None), (3_004, [0.0, 0.0, 0.0], None)]
    got = {r["id"]: r["cluster"] for r in cluster_by_density(spark.createDataFrame(groups + lonely + odd, SCHEMA), 0.3, 5).collect()}
    assert {got[i] for i, *_ in groups[:900]} <= {0, -1} and sum(got[i] == 0 for i in range(900)) > 880
    assert {got[i] for i, *_ in groups[900:]} == {1}
    assert all(got[i] == -1 for i, *_ in [*lonely, *odd])


def test_no_fixed_share_is_noise(spark):
    rows = [(i, [i % 10 / 10, 0.0], None) for i in range(500)]
    assert {r["cluster"] for r in cluster_by_density(spark.createDataFrame(rows, SCHEMA), 0.5, 5).collect()} == {0}
    alone = [(i, [i * 9.0, 0.0], None) for i in range(50)]
    assert {r["cluster"] for r in cluster_by_density(spark.createDataFrame(alone, SCHEMA), 0.5, 5).collect()} == {-1}


def test_empty_and_too_wide(spark):
    assert cluster_by_density(spark.createDataFrame([], SCHEMA), 1.0).collect() == []
    with pytest.raises(ValueError):
        cluster_by_density(spark.createDataFrame([(1, [0.0] * 9, None)], SCHEMA), 1.0)


def test_components_of_long_ways(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (502, 501), (600, 600)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500, 502: 500, 600: 600}
