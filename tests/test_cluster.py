"""Clusters and trimming against one merge, and one code, at a time."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from quaymark.operators import cluster


def one_by_one(points: np.ndarray, height: float) -> list[int]:
    """Ward clusters of points in space, by centres: the cheapest pair merges until it costs more than ``height``."""
    groups = [[i] for i in range(len(points))]

    def cost(x, y):
        a, b = points[x].mean(axis=0), points[y].mean(axis=0)
        return np.sqrt(2 * len(x) * len(y) / (len(x) + len(y))) * np.linalg.norm(a - b)

    while len(groups) > 1:
        i, j = min(itertools.combinations(range(len(groups)), 2), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        if cost(groups[i], groups[j]) > height:
            break
        groups[i] = sorted(groups[i] + groups.pop(j))
    number = {i: k for k, g in enumerate(sorted(groups), 1) for i in g}
    return [number[i] for i in range(len(points))]


@pytest.mark.parametrize("height", [0.6, 9.0])
def test_ward_equals_one_merge_at_a_time(spark, height):
    points = np.random.default_rng(int(height * 10)).normal(size=(10, 3)) * 0.5
    rows = [(f"c{i:02}", f"c{j:02}", float(1 - np.linalg.norm(points[i] - points[j]))) for i, j in itertools.combinations(range(10), 2)]
    pairs = spark.createDataFrame(rows, "code_a string, code_b string, corr double")
    found = {r["code"]: r["cluster"] for r in cluster.ward_clusters(pairs, height).collect()}
    assert [found[f"c{i:02}"] for i in range(10)] == one_by_one(points, height)


def test_pairs_without_correlation_are_far(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("c", "d", 0.9)], "code_a string, code_b string, corr double")
    assert {r["code"]: r["cluster"] for r in cluster.ward_clusters(pairs, 0.5).collect()} == {"a": 1, "b": 1, "c": 2, "d": 2}


def test_trimming_equals_one_code_at_a_time(spark):
    rng = np.random.default_rng(7)
    codes = [f"c{i:02}" for i in range(14)]
    corr = {p: float(rng.uniform(-1, 1)) for p in itertools.combinations(codes, 2)}
    score = {c: float(rng.integers(0, 10)) for c in codes}
    kept: list[str] = []
    for code in sorted(codes, key=lambda c: (-score[c], c)):
        if all(corr[min(code, k), max(code, k)] <= 0.6 for k in kept):
            kept.append(code)
    found = cluster.trim_clones(
        spark.createDataFrame([(*p, c) for p, c in corr.items()], "code_a string, code_b string, corr double"),
        spark.createDataFrame(list(score.items()), "code string, score double"), 0.6,
    )
    assert [r["code"] for r in found.orderBy("rank").collect()] == kept


def joins_one_by_one(points: np.ndarray) -> dict[tuple[int, int], float]:
    """The height at which each pair comes together, merging the cheapest clusters first."""
    groups, out = [[i] for i in range(len(points))], {}

    def cost(x, y):
        a, b = points[x].mean(axis=0), points[y].mean(axis=0)
        return np.sqrt(2 * len(x) * len(y) / (len(x) + len(y))) * np.linalg.norm(a - b)

    while len(groups) > 1:
        i, j = min(itertools.combinations(range(len(groups)), 2), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        out |= {(min(a, b), max(a, b)): cost(groups[i], groups[j]) for a in groups[i] for b in groups[j]}
        groups[i] = sorted(groups[i] + groups.pop(j))
    return out


def test_merge_heights_and_related_clusters(spark):
    points = np.random.default_rng(4).normal(size=(9, 3)) * 0.5
    rows = [(f"c{i}", f"c{j}", float(1 - np.linalg.norm(points[i] - points[j]))) for i, j in itertools.combinations(range(9), 2)]
    heights = cluster.merge_heights(spark.createDataFrame(rows, "code_a string, code_b string, corr double")).cache()
    want = joins_one_by_one(points)
    found = {(int(r["code_a"][1]), int(r["code_b"][1])): r["height"] for r in heights.collect()}
    assert found.keys() == want.keys() and all(found[p] == pytest.approx(want[p]) for p in want)
    member = {i: i % 4 for i in range(9)}
    members = spark.createDataFrame([(f"c{i}", k) for i, k in member.items()], "code string, cluster int")
    picked = {0: 0.5, 4: 0.1, 1: 0.2, 2: None}
    near = {}
    for missed in {3}:
        for other in (0, 1, 2):
            near[other] = min(want[min(a, b), max(a, b)] for a in member for b in member if member[a] == missed and member[b] == other)
    order = sorted(near, key=lambda k: (round(near[k], 9), {0: -0.5, 1: -0.2, 2: 9}[k], k))
    got = cluster.related_clusters(heights, members, spark.createDataFrame([(f"c{i}", r) for i, r in picked.items()], "code string, ret double"), 2).orderBy("place").collect()
    assert [(r["cluster"], r["place"], r["related"]) for r in got] == [(3, 1, order[0]), (3, 2, order[1])]
    assert got[0]["height"] == pytest.approx(near[order[0]]) and {tuple(r["codes"]) for r in got} <= {("c0", "c4"), ("c1",), ("c2",)}
    none = spark.createDataFrame([], "code_a string, code_b string, corr double")
    assert cluster.merge_heights(none).count() == 0
