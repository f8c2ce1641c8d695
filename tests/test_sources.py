"""Readers and writers of files."""

from __future__ import annotations

import json

import numpy as np
import pytest

from quaymark.sources import bars, sinks


def test_feature_files(spark, tmp_path):
    np.array([3, 1.5, np.nan, 2.5], "<f4").tofile(tmp_path / "close.day.bin")
    np.array([0], "<f4").tofile(tmp_path / "empty.day.bin")
    found = bars.feature_series(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r["position"], r["value"]) for r in found] == [(3, 1.5), (4, None), (5, 2.5)]


def test_csv_encodings_and_columns(spark, tmp_path):
    for name, encoding in (("a", "utf-8"), ("b", "iso-8859-1")):
        (tmp_path / f"{name}.csv").write_bytes("code,pr\u00e9nom\nX1,\u00e9t\u00e9\n".encode(encoding))
    for rows in bars.read_tables(spark, str(tmp_path), {"a": ["code"], "b": ["code", "pr\u00e9nom"]}).values():
        assert [tuple(r) for r in rows.collect()] == [("X1", "\u00e9t\u00e9")]
    with pytest.raises(ValueError, match="lacks price"):
        bars.read_csv(spark, str(tmp_path / "a.csv"), ["code", "price"])


def test_config(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"a": 2}))
    assert bars.read_config(spark, str(path), {"a": 1, "b": 3}) == {"a": 2, "b": 3}
    path.write_text(json.dumps({"z": 2}))
    with pytest.raises(ValueError, match="unknown settings: z"):
        bars.read_config(spark, str(path), {"a": 1})


def test_mapping_export(spark, tmp_path):
    codes = spark.createDataFrame([("b",), ("a",), ("a",)], "code string")
    sinks.export_mapping(codes, spark.createDataFrame([("a", 1.5)], "code string, size double"), str(tmp_path / "m"), {"size": "Size"})
    found = spark.read.option("header", True).csv(str(tmp_path / "m")).collect()
    assert sorted((r["code"], r["Size"]) for r in found) == [("a", "1.5"), ("b", None)]


def test_missing_columns_of_a_batch(spark):
    a, b = spark.createDataFrame([(1, 1, "x")], "k long, seq long, v string"), spark.createDataFrame([(1, 2), (2, 1)], "k long, seq long")
    assert sorted(map(tuple, sinks.merge_latest([a, b], ["k"], "seq").collect())) == [(1, 2, None), (2, 1, None)]
