from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest

from quaymark.streaming import bars


@pytest.fixture()
def folder(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("A", start + dt.timedelta(hours=6 * i), 10.0 + i % 5) for i in range(12)]
    spark.createDataFrame(rows, "code string, ts timestamp, price double").coalesce(1).write.parquet(str(tmp_path / "in"))
    return tmp_path


def run(spark, df, folder, mode):
    name = f"q{abs(hash(str(folder))) % 10**8}_{mode}"
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / f"c_{mode}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).toPandas()


def test_stream_bars_equal_table_bars(spark, folder):
    schema = "code string, ts timestamp, price double"
    stream = spark.readStream.schema(schema).parquet(str(folder / "in"))
    found = run(spark, bars.bars(stream), folder, "complete").sort_values("start", ignore_index=True)
    want = bars.bars(spark.read.parquet(str(folder / "in"))).toPandas().sort_values("start", ignore_index=True)
    pd.testing.assert_frame_equal(found, want)


def test_running_sigma_keeps_state(spark, folder):
    stream = spark.readStream.schema("code string, ts timestamp, price double").parquet(str(folder / "in"))
    found = run(spark, bars.running_sigma(stream), folder, "append").sort_values("ts", ignore_index=True)
    var, last, want = None, None, []
    for p in found["price"]:
        if last is not None:
            r2 = (p / last - 1) ** 2
            var = r2 if var is None else 0.94 * var + 0.06 * r2
        last = p
        want.append(None if var is None else var**0.5)
    assert found["sigma"][1:].tolist() == pytest.approx(want[1:])
    assert pd.isna(found["sigma"][0])
