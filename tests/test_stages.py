"""Stage rules one bar at a time, the choice by hand, and the book."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from quaymark.operators import stages as st

DAY = dt.date(2020, 1, 1)


def bars(seed=1, n=400, code="A"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
    open_ = close * np.exp(rng.normal(0, 0.02, n))
    high, low = np.maximum(open_, close) * (1 + rng.random(n) * 0.01), np.minimum(open_, close) * (1 - rng.integers(0, 2, n) * 0.01)
    label = np.repeat(rng.choice(["up", "down", "range"], n // 10 + 1), 10)[:n]
    d = [DAY + dt.timedelta(days=i) for i in range(n)]
    return pd.DataFrame({"code": code, "d": d, "open": open_, "high": high, "low": low, "close": close, "volume": 1.0}), pd.DataFrame({"code": code, "d": d, "label": label})


def ended(rule, stage, label, i, j, close, high, flags):
    """Why and at what price a trade of bar i ends at bar j, checked as of that bar."""
    if rule.gain is not None:
        if high[j] / close[i] - 1 >= rule.gain:
            return close[i] * (1 + rule.gain)
        return close[j] if close[j] / close[i] - 1 <= rule.loss or j - i >= rule.days else None
    if rule.trail is not None:
        hit = close[j] <= max(high[i : j + 1]) * (1 - rule.trail)
    else:
        hit = label[j] != "up" if rule.signal == "leave" else flags[rule.signal][j]
    return close[j] if hit or (stage == "up" and label[j] != "up") else None


def slow_trades(g, on, spec, stage_of, force):
    """State by state: (entry, exit, price, still open)."""
    close, high, label = g["close"].tolist(), g["high"].tolist(), g["label"].tolist()
    flags = {s: g[s].tolist() for s in st.SIGNALS}
    out, i = [], None
    for j in range(len(close)):
        if i is None:
            i = j if on[j] else None
            continue
        px = ended(spec(stage_of(i)), stage_of(i), label, i, j, close, high, flags)
        if px is not None:
            out.append((i, j, px, False))
            i = None
    if i is not None:
        out.append((i, len(close) - 1, close[-1], True))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    made = [bars(s, code=c) for s, c in ((1, "A"), (2, "B"))]
    all_bars, labels = (spark.createDataFrame(pd.concat(x)) for x in zip(*made, strict=True))
    return st.stage_rows(all_bars.withColumn("d", all_bars["d"].cast("date")), labels.withColumn("d", labels["d"].cast("date"))).cache()


def test_sweep_one_bar_at_a_time(rows):
    found = {(r["code"], r["stage"], r["buy"], r["exit"]): r for r in st.sweep(rows).collect()}
    assert len(found) == 2 * len(st.rules())
    frame = rows.toPandas().sort_values(["code", "d"])
    traded = 0
    for (code, stage, buy, exit_), r in found.items():
        rets = []
        for _, g in frame[(frame["code"] == code) & (frame["label"] == stage)].groupby("run_no"):
            if len(g) > 1:
                on = [k == 0 for k in range(len(g))] if buy == "enter" else g[f"buy_{buy}"].tolist()
                close = g["close"].tolist()
                rets += [px / close[i] - 1 for i, _, px, _ in slow_trades(g, on, lambda s, e=exit_: st.EXITS[s][e], lambda i, s=stage: s, True)]
        assert (r["n_trades"], r["wins"]) == (len(rets), sum(x > 0 for x in rets))
        assert r["compound"] == pytest.approx(np.prod([1 + x for x in rets]) - 1) and r["mean_ret"] == pytest.approx(np.mean(rets) if rets else 0.0)
        traded += len(rets) > 0
    assert traded > 100


def test_choice_by_hand(spark):
    def row(code, stage, buy, exit_, n, score):
        return (code, stage, buy, exit_, n, 0, 0.0, 0.0, score, 0.0)

    found = spark.createDataFrame(
        [
            row("A", "up", "cross", "death", 5, 0.10), row("B", "up", "cross", "death", 5, 0.30), row("A", "up", "green", "death", 1, 0.50), row("B", "up", "green", "death", 0, 0.0),
            row("A", "down", "floor", "trail10", 4, -0.5), row("B", "down", "floor", "trail10", 2, 0.1), row("A", "range", "cross", "trail10", 0, 0.0), row("B", "range", "cross", "trail10", 3, 0.2),
        ],
        st.SWEEP,
    )
    prior = st.pool_prior(found)
    assert {(r["stage"], r["buy"]): r["prior"] for r in prior.collect()} == pytest.approx({("up", "cross"): 0.2, ("up", "green"): 0.5, ("down", "floor"): -0.2, ("range", "cross"): 0.2})
    got = {(r["code"], r["stage"]): r for r in st.choose(found, prior).collect()}
    assert got["A", "up"]["buy"] == "green" and got["A", "up"]["posterior"] == pytest.approx(0.5)
    assert got["B", "up"]["buy"] == "cross" and got["B", "up"]["posterior"] == pytest.approx((5 * 0.3 + 5 * 0.2) / 10)
    assert got["A", "down"]["buy"] == "none" and got["B", "down"]["buy"] == "none" and got["A", "range"]["buy"] == "none"
    assert got["B", "range"]["posterior"] == pytest.approx((3 * 0.2 + 5 * 0.2) / 8) and len(got) == 6
    assert {r["place"] for r in st.ranked(prior).collect()} == {1, 2}


def test_book_one_bar_at_a_time(spark, rows):
    picks = {"up": ("enter", "trail15"), "down": ("deep_5", "tp8_sl5_h8"), "range": ("near_low_green", "break_ma20")}
    chosen = [("A", s, *p) for s, p in picks.items()] + [("B", s, *(("none", "none") if s == "up" else p)) for s, p in picks.items()]
    found = st.book(rows, spark.createDataFrame(chosen, "code string, stage string, buy string, exit string")).collect()
    frame = rows.toPandas().sort_values(["code", "d"])
    for code in "AB":
        g = frame[frame["code"] == code]
        label, d, close = g["label"].tolist(), g["d"].tolist(), g["close"].tolist()
        mine = {s: (b, e) for c, s, b, e in chosen if c == code}
        on = [mine[x][0] != "none" and (k == 0 or label[k - 1] != x if mine[x][0] == "enter" else bool(g[f"buy_{mine[x][0]}"].iloc[k])) for k, x in enumerate(label)]
        want = slow_trades(g, on, lambda s, m=mine: st.EXITS[s][m[s][1]], lambda i, x=label: x[i], False)
        got = sorted((r for r in found if r["code"] == code), key=lambda r: r["entry_d"])
        assert [(r["entry_d"], r["exit_d"], r["open"]) for r in got] == [(d[i], d[j], o) for i, j, _, o in want] and len(want) > 5
        assert [r["ret"] for r in got] == pytest.approx([px / close[i] - 1 for i, _, px, _ in want])


def test_no_rows(spark, rows):
    assert st.sweep(rows.where("code = 'x'")).count() == 0
    assert st.book_summary(st.book(rows, spark.createDataFrame([], "code string, stage string, buy string, exit string"))).count() == 0
