from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from quaymark.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double, ids string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, 0.0, "x") for i, v in rows], SCHEMA)


def brute(rows, every, k=10):
    """(query, rank) -> (id, distance) over all rows."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % every == 0:
            d = np.sqrt(np.square(x - v).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out |= {(int(i), n): (int(ids[j]), d[j]) for n, j in enumerate(order, 1)}
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows, 50)
    found = ann.nearest(table(spark, rows), every=50, shortlist=100).collect()
    assert len(found) == len(want)
    near = {q: {v for (a, _), (v, _) in want.items() if a == q} for q, _ in want}
    assert np.mean([r["vec_id"] in near[r["query_id"]] for r in found]) >= 0.95
    x32 = x.astype(np.float32).astype(float)
    for r in found[:300]:
        assert r["score"] == np.sqrt(np.square(x32[r["vec_id"]] - x32[r["query_id"]]).sum())


@pytest.mark.parametrize("spread", [0.3, 5.0])
def test_leaves_and_parts_keep_the_recall(spark, monkeypatch, spread):
    """Clusters need few leaves, isotropic vectors nearly all; parts and blocks change nothing."""
    monkeypatch.setattr(ann, "LEAF", 100)
    monkeypatch.setattr(ann, "BLOCK", 60)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)] * 3 + spread * rng.normal(size=(3000, 16))
    leaves = ann.Leaves.fit(x, len(x))
    assert len(leaves.centres) == 30 and (leaves.probes <= 6 if spread < 1 else leaves.probes >= 15)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, found = brute(rows, 50), ann.nearest(table(spark, rows), every=50).collect()
    assert len(found) == len(want)
    near = {q: {v for (a, _), (v, _) in want.items() if a == q} for q, _ in want}
    assert np.mean([r["vec_id"] in near[r["query_id"]] for r in found]) >= 0.95


def test_each_length_is_searched_apart(spark):
    rows = [(100 * i, [float(i), 1.0]) for i in range(1, 4)] + [(1000 * i, [float(i), 1.0, 2.0]) for i in range(1, 3)]
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(table(spark, rows)).collect()}
    assert found == {(100, 1): (200, 1.0), (100, 2): (300, 2.0), (200, 1): (100, 1.0), (200, 2): (300, 1.0), (300, 1): (200, 1.0), (300, 2): (100, 2.0),
                     (1000, 1): (2000, 1.0), (2000, 1): (1000, 1.0)}


def test_one_id_of_two_vectors(spark):
    rows = [(100, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [5.0, 0.0]), (2, [9.0, 0.0])]
    found = [tuple(r) for r in ann.nearest(table(spark, rows)).orderBy("rank").collect()]
    assert found == [(100, 1, 1, 1.0), (100, 2, 1, 4.0), (100, 3, 2, 8.0)]


def test_codes_pack_to_half_bytes():
    codes = np.random.default_rng(4).integers(0, 16, (9, 7)).astype(np.uint8)
    assert (ann.unpacked(pd.Series(ann.packed(codes)), 7) == codes.T).all() and len(ann.packed(codes)[0]) == 4


def test_ties_and_copies_go_to_the_least_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(40)] + [(i, [1.0, 2.0, float(i)]) for i in range(40, 60)]
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(table(spark, rows), every=20).collect()}
    assert found == {k: (v, pytest.approx(d)) for k, (v, d) in brute(rows, 20).items()}


def test_bad_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, None), (200, []), (300, [nan, 1.0]), (400, [inf, 1.0]), (500, [0.0, 0.0]), (600, [None, 1.0]),
            (None, [1.0, 1.0]), (700, [1.0, 2.0, 3.0]), (1, [2.0, 0.0]), (2, [4.0, 0.0]), (2, [4.0, 0.0])]
    found = [tuple(r) for r in ann.nearest(table(spark, rows)).orderBy("rank").collect()]
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 3.0)]


def test_empty_tables(spark):
    assert ann.nearest(table(spark, [])).count() == 0
    assert ann.nearest(table(spark, [(0, [1.0])])).count() == 0


def test_anisotropic_codes_have_less_parallel_error():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = ann.Codebook.fit(x)

    def parallel(codes):
        made = np.stack([book.centres[m][codes[:, m]] for m in range(codes.shape[1])], axis=1).reshape(len(x), -1)
        return np.square(((x - made) * x).sum(axis=1)).mean()

    assert parallel(book.encode(x, 2)) < parallel(book.encode(x, 0))


def awkward(kind):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 32))
    if kind == "dense clusters":
        return rng.normal(size=(5, 32))[rng.integers(0, 5, 3000)] * 3 + 0.01 * x
    if kind == "far from the origin":
        return x + 300
    if kind == "norms of all sizes":
        return x * np.exp(2 * rng.normal(size=(3000, 1)))
    return np.where(np.arange(3000)[:, None] % 100 == 0, 5 + 0.02 * x, x)  # the queries lie apart, in less than a part of a leaf


@pytest.mark.parametrize("kind", ["dense clusters", "far from the origin", "norms of all sizes", "queries apart"])
@pytest.mark.parametrize("leaf", [8192, 200])
def test_vectors_the_codes_hardly_tell_apart(spark, monkeypatch, kind, leaf):
    monkeypatch.setattr(ann, "LEAF", leaf)
    rows = [(i, v.tolist()) for i, v in enumerate(awkward(kind))]
    want = brute(rows, 100)
    near = {(q, v) for (q, _), (v, _) in want.items()}
    found = ann.nearest(table(spark, rows)).collect()
    assert len(found) == len(want)
    assert np.mean([(r["query_id"], r["vec_id"]) in near for r in found]) >= 0.99


def test_leaves_beyond_the_first_are_scanned_where_near_vectors_may_be():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    leaves = ann.Leaves.fit(x, 100 * ann.LEAF)
    leaves.probes = 1
    home = leaves.nearest(x, 1)[:, 0]
    radii = np.array([np.linalg.norm(x[home == j] - leaves.centres[j], axis=1).max() for j in range(len(leaves.centres))])
    distances = np.sqrt(np.square(x[:50, None] - x).sum(axis=2))
    limits = np.sort(distances, axis=1)[:, 10]
    rest = leaves.others(x[:50], limits, radii)
    for i in range(50):
        assert set(home[distances[i] <= limits[i]]) <= {home[i], *rest[i]}
    assert max(map(len, rest)) < len(radii) - 1
