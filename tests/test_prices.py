from __future__ import annotations

import datetime as dt

import pytest

from quaymark import schemas
from quaymark.operators import prices
from quaymark.sources.bars import snapshot_bars
from quaymark.sources.sinks import freeze, upsert, write_partitions

DAY = dt.date(2020, 1, 1)


def bars(spark, closes, opens=None):
    rows = [
        ("A", DAY + dt.timedelta(i), (opens or closes)[i], c, c, c, 1.0) for i, c in enumerate(closes)
    ]
    return spark.createDataFrame(rows, schemas.BARS)


def closes(df):
    return [r["close"] for r in df.orderBy("d").collect()]


def walked(values):
    """The factors by a walk from the newest bar."""
    out, factor, newer = [], 1.0, None
    for c in reversed(values):
        if c is not None and c > 0 and newer is not None and abs(newer / c - 1) > prices.CLIFF:
            ratio = newer / c
            best = min(prices.RATIOS, key=lambda r: abs(ratio / r - 1))
            factor *= best if abs(ratio / best - 1) <= prices.SNAP else ratio
        out.append(factor)
        newer = c if c is not None and c > 0 else newer
    return out[::-1]


@pytest.mark.parametrize(
    "values",
    [[60.0, 20.0, 20.2, 9.9], [210.0, 21.2, 20.7, 206.0], [12.0, 36.8], [81.0, 26.4], [44.0, None, 21.6], [7.0], [31.0, 33.0, 30.5]],
)
def test_factor_equals_walk(spark, values):
    found = [r["factor"] for r in prices.split_steps(bars(spark, values)).orderBy("d").collect()]
    want = [w if v else f for v, w, f in zip(values, walked(values), found, strict=True)]  # the factor of a hole scales nothing
    assert found == pytest.approx(want, rel=1e-12)


def test_two_round_splits_compound(spark):
    assert closes(prices.adjust(bars(spark, [60.0, 20.0, 20.2, 9.9])))[0] == pytest.approx(10.0)


def test_open_ratio_wins(spark):
    found = prices.split_steps(bars(spark, [90.0, 47.0], [91.0, 30.5])).orderBy("d").collect()
    assert found[1]["step"] == pytest.approx(1 / 3)


def test_second_pass_changes_nothing(spark):
    once = prices.adjust(bars(spark, [81.0, 26.4]))
    assert closes(prices.adjust(once)) == pytest.approx(closes(once))


def test_halted_quote_is_flat(spark):
    schema = "code string, d date, last double, open double, high double, low double, volume double, pre_close double"
    rows = [("A", DAY, 0.0, None, 0.0, 0.0, 0.0, 2.5), ("B", DAY, 3.0, None, None, 3.2, 5.0, 2.9), ("C", DAY, None, None, None, None, None, None)]
    found = {r["code"]: r for r in snapshot_bars(spark.createDataFrame(rows, schema)).collect()}
    assert set(found) == {"A", "B"}
    assert (found["A"]["open"], found["A"]["high"], found["A"]["low"], found["A"]["close"], found["A"]["halted"]) == (2.5, 2.5, 2.5, 2.5, True)
    assert (found["B"]["open"], found["B"]["high"], found["B"]["low"]) == (3.0, 3.0, 3.0)


def test_snapshot_and_upsert_replace_a_day(spark):
    old, new = bars(spark, [1.0, 2.0]), bars(spark, [9.0])
    assert closes(prices.apply_snapshot(old, new)) == [9.0, 2.0]
    assert closes(upsert(old, new, ["code", "d"])) == [9.0, 2.0]


def test_gap_kinds(spark):
    seen = spark.createDataFrame([("A", DAY), ("B", DAY)], "code string, d date")
    assert {r["code"]: (r["n_new"], r["gap"]) for r in prices.date_gap(seen, bars(spark, [1.0, 2.0])).collect()} == {"A": (1, "plus_one"), "B": (0, "empty")}


def test_partition_write_is_idempotent_and_freeze_refuses(spark, tmp_path):
    rows, path = bars(spark, [1.0, 2.0]), str(tmp_path / "p")
    for _ in range(2):
        write_partitions(rows, path, "d")
    write_partitions(bars(spark, [5.0]), path, "d")
    assert sorted(r["close"] for r in spark.read.parquet(path).collect()) == [2.0, 5.0]
    freeze(rows, str(tmp_path / "f"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        freeze(rows, str(tmp_path / "f"))
