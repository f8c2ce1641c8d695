"""A feature of a day never depends on later days."""

from __future__ import annotations

import pytest

from quaymark.functions import windows as w
from quaymark.operators import features, machines, regimes, signals
from quaymark.sources.bars import derive_bars


def full(bars):
    rows = features.vol_regime(features.multi_scale(bars, ["fig9", "fig10"]))
    rows = features.six_states(signals.aux_signals(features.moving_averages(rows)))
    return regimes.raw_regime(regimes.regime_features(rows.drop("r", "rv20")))


def test_prefix_equals_full_run(spark, sf_dir):
    bars = derive_bars(spark, sf_dir).where("code = 'C0'")
    rows = bars.orderBy("d").limit(420).toPandas()
    whole = spark.createDataFrame(rows)
    part = spark.createDataFrame(rows.iloc[:300])
    columns = ["d", "fig9_path", "fig9_lower", "fig10_pos", "rv_pct", "state", "aux_buy", "raw"]
    a = full(whole).select(columns).orderBy("d").limit(300).toPandas()
    b = full(part).select(columns).orderBy("d").toPandas()
    for c in columns[1:]:
        if a[c].dtype == float:
            assert (a[c] - b[c]).abs().max() < 1e-12 and a[c].isna().equals(b[c].isna())
        else:
            assert a[c].equals(b[c])


def test_kalman_prefix(spark, sf_dir):
    rows = derive_bars(spark, sf_dir).where("code = 'C0'").orderBy("d").limit(600).select("code", "d", "close").toPandas()
    a = machines.kalman_trend(spark.createDataFrame(rows)).orderBy("d").limit(550).toPandas()
    b = machines.kalman_trend(spark.createDataFrame(rows.iloc[:550])).orderBy("d").toPandas()
    assert (a["path"] - b["path"]).abs().max() < 1e-9


def test_run_in_window_counts_inside_it(spark):
    rows = spark.createDataFrame([("A", i, i in (0, 1, 2)) for i in range(6)], "code string, d int, f boolean")
    found = [r["x"] for r in rows.withColumn("x", w.run_in_window("f", 3, 3)).orderBy("d").collect()]
    assert found == [False, False, True, False, False, False]


def test_cooldown_counts_from_the_last_kept(spark):
    rows = spark.createDataFrame([("A", i, i in (0, 3, 6, 11)) for i in range(12)], "code string, d int, s boolean")
    assert sorted(r["d"] for r in signals.cooldown(rows, "s", 5).collect()) == [0, 6, 11]


@pytest.mark.parametrize("closes, reason", [([10, 10, 8, 7], "stop"), ([10, 10, 10, 10], "open")])
def test_independent_trades(spark, closes, reason):
    rows = spark.createDataFrame([("A", i, float(c), i == 0) for i, c in enumerate(closes)], "code string, d int, close double, s boolean")
    assert signals.signal_trades(rows, "s").first()["reason"] == reason


def test_grouped_map_equals_windows(spark, sf_dir):
    rows = features.with_logs(derive_bars(spark, sf_dir)).where("code = 'C1'")
    names = ["fig9", "fig11"]
    a = features.paths_and_rails(rows, names).orderBy("d").toPandas()
    b = features.rails(features.fair_path(rows, names), names).orderBy("d").toPandas()
    for p in names:
        for part in ("path", "g", "gap", "lower", "upper"):
            x, y = a[f"{p}_{part}"], b[f"{p}_{part}"]
            assert x.isna().equals(y.isna()) and ((x - y).abs() / y.abs().clip(lower=1)).max() < 1e-9
