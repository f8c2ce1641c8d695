"""Isotonic fits against minimisation over all rising functions, thresholds against a loop over draws."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pytest

from quaymark.operators import gates


def slow_isotonic(x, y):
    """Least squares by the max-min formula: the value at each x is the max over starts of the min over ends of the mean."""
    xs = np.unique(x)
    total, n = (np.array([f(y[x == v]) for v in xs]) for f in (np.sum, len))
    mean = lambda a, b: total[a : b + 1].sum() / n[a : b + 1].sum()
    return xs, np.array([max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))])


@pytest.mark.parametrize("seed", range(5))
def test_pooling_in_parts_equals_pooling_at_once(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 40, 200) / 40
    y = (rng.random(200) < x).astype(float)
    xs, want = slow_isotonic(x, y)
    total, n = (np.array([f(y[x == v]) for v in xs]).astype(float) for f in (np.sum, len))
    once = gates.pooled(xs, xs, total, n)
    parts = list(itertools.chain(*(gates.pooled(xs[s], xs[s], total[s], n[s]) for s in (slice(0, 11), slice(11, 13), slice(13, None)))))
    assert gates.pooled(*(np.array([p[k] for p in parts]) for k in range(4))) == once
    got = np.concatenate([np.full(sum((xs >= a) & (xs <= b)), s / w) for a, b, s, w in once])
    np.testing.assert_allclose(got, want)


def test_calibration_by_group(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g, n in (("a", 800), ("b", 700), ("few", 100)):
        for s in rng.random(n).round(2):
            rows.append((g, float(s), bool(rng.random() < s**2)))
    train = spark.createDataFrame(rows, "g string, p double, y boolean")
    probe = spark.createDataFrame([(g, float(p)) for g in ("a", "b", "few") for p in np.linspace(-0.1, 1.1, 61)], "g string, p double")
    found = gates.calibrated(train.repartition(5), probe, "g", "p", "y").orderBy("g", "p").collect()
    assert {r["isotonic"] for r in found if r["g"] != "few"} == {True}
    for g in ("a", "b"):
        x, y = (np.array([r[k] for r in rows if r[0] == g], float) for k in (1, 2))
        xs, ys = slow_isotonic(x, y)
        mine = [r for r in found if r["g"] == g]
        want = np.interp([r["p"] for r in mine], xs, ys)
        np.testing.assert_allclose([r["calibrated"] for r in mine], want, atol=1e-9)
    assert all(r["calibrated"] == r["p"] and not r["isotonic"] for r in found if r["g"] == "few")


def test_threshold_one_draw_at_a_time(spark):
    rng = np.random.default_rng(3)
    rows = [(float(round(s, 2)), bool(rng.random() < s), f"m{rng.integers(0, 9)}") for s in rng.random(900)]
    frame = spark.createDataFrame(rows, "p double, y boolean, month string")
    blocks = sorted({r[2] for r in rows})
    picked = []
    for draw in range(50):
        picked.append({blocks[int(hashlib.md5(f"42:{draw}:{k}".encode()).hexdigest()[:8], 16) % len(blocks)] for k in range(len(blocks))})
    want = {}
    for thr in sorted({r[0] for r in rows}, reverse=True):
        over = [r for r in rows if r[0] >= thr]
        if len(over) >= 50:
            shares = [np.mean([not r[1] for r in over if r[2] in p]) for p in picked if any(r[2] in p for r in over)]
            want[thr] = (len(over), np.mean([not r[1] for r in over]), np.quantile(shares, 0.95))
    found = {r["thr"]: (r["n"], r["share"], r["upper"]) for r in gates.false_shares(frame, "p", "y", "month", 50).collect()}
    assert found.keys() == want.keys()
    for thr in want:
        assert found[thr] == pytest.approx(want[thr])
    best = gates.false_threshold(frame, "p", "y", "month", times=50).first()
    ok = [t for t, v in want.items() if v[2] <= 0.2]
    assert ok and best["q_confirm"] == max(ok) and best["n"] == want[max(ok)][0] and best["reason"] is None
    worse = gates.false_threshold(frame, "p", "y", "month", target=0.0, times=50).first()
    assert worse["q_confirm"] is None and worse["reason"] == "no_threshold" and worse["n"] == 0
    assert gates.false_threshold(frame.where("p > 2"), "p", "y", "month", times=5).first()["reason"] == "no_threshold"
