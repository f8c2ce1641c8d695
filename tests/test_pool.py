"""The pool against one code at a time."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quaymark.operators import pool


def slow_quotas(sizes, best, target):
    total = sum(sizes.values())
    raw = {c: n / total * target for c, n in sizes.items()}
    cap = {c: max(1, min(math.ceil(raw[c]), n)) for c, n in sizes.items()}
    want = target + min(max(5, math.ceil(target * 0.15)), max(0, total - target))
    while sum(cap.values()) < want:
        room = [c for c in sizes if cap[c] < sizes[c]]
        if not room:
            break
        cap[min(room, key=lambda c: (-(raw[c] - math.floor(raw[c])), -sizes[c], -best[c], c))] += 1
    return raw, cap


def slow(members, corr, target, forced):
    by = {}
    for code, cluster, score, enough in members:
        by.setdefault(cluster, []).append((code, score, enough))
    order = {c: [x[0] for x in sorted([m for m in ms if m[2]] or ms, key=lambda m: (-m[1], m[0]))] for c, ms in by.items()}
    score, where = {m[0]: m[2] for m in members}, {m[0]: m[1] for m in members}
    raw, cap = slow_quotas({c: len(o) for c, o in order.items()}, {c: max(score[x] for x in o) for c, o in order.items()}, target)
    picks = [(x, i) for c, o in order.items() if not set(o) & forced for i, x in enumerate(o[: cap[c]])]
    first = sorted([x for x, i in picks if i == 0], key=lambda x: (-score[x], -raw[where[x]], where[x], x))
    rest = [x for x, i in sorted([p for p in picks if p[1]], key=lambda p: (-score[p[0]], -raw[where[p[0]]], where[p[0]], p[1], p[0]))]
    ours = sorted((x for x in score if x in forced), key=lambda x: (where[x], x))
    final = (ours + [x for x in first + rest if x not in forced])[:target]

    def clone(x, kept):
        return any(abs(corr[frozenset((x, y))]) > (0.60 if where[x] == where[y] else 0.70) for y in kept)

    kept = []
    for x in final:
        if x in forced or not clone(x, kept):
            kept.append(x)
    rescued = []
    for c in sorted(order):
        if c not in {where[x] for x in kept}:
            for x in order[c]:
                if x not in final and not clone(x, kept + rescued):
                    rescued.append(x)
                    break
    return kept, rescued


@pytest.mark.parametrize("seed", range(3))
def test_pool_one_code_at_a_time(spark, seed):
    rng = np.random.default_rng(seed)
    members = [(f"c{i:02}", int(rng.integers(1, 8)), float(round(rng.random(), 2)), bool(rng.random() < 0.8)) for i in range(32)]
    corr = {frozenset((members[i][0], members[j][0])): float(rng.uniform(-0.8, 0.85)) for i in range(32) for j in range(i)}
    forced = {members[3][0], members[17][0]}
    target = 12
    kept, rescued = slow(members, corr, target, forced)
    frame = spark.createDataFrame(members, "code string, cluster int, score double, enough boolean")
    pairs = spark.createDataFrame([(*sorted(k), v) for k, v in corr.items()], "code_a string, code_b string, corr double")
    found = pool.select_pool(frame, pairs, target, spark.createDataFrame([(x,) for x in forced], "code string")).orderBy("seat").collect()
    assert [r["code"] for r in found if r["how"] != "rescue"] == kept
    assert [r["code"] for r in found if r["how"] == "rescue"] == rescued
    _, cap = slow_quotas(*[{c: f([m[2] for m in members if m[1] == c]) for c in {m[1] for m in members}} for f in (len, max)], target)
    every = pool.candidates(frame.selectExpr("code", "cluster", "score", "true enough"))
    assert {r["cluster"]: r["cap"] for r in pool.quotas(every, target).collect()} == cap
