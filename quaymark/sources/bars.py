"""Daily bars: from the star schema, from files, and on a calendar."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a code stands for, and the size of its daily moves.
KEYS = {"region": ("n_regionkey", "C", 0.05), "nation": ("n_nationkey", "N", 0.02)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean(value: Column) -> Column:
    """NaN and infinities as NULL, so comparisons are never true of a missing value."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def derive_bars(spark: SparkSession, sf_dir: str, key: str = "region") -> DataFrame:
    """Bars of ``code, d, open, high, low, close, volume`` from line items by supplier.

    The mean price of a day drives that day's return around the code's own
    mean, so prices are realistic walks. One shuffle by code and day; the
    windows by code reuse its rows, one for each day.
    """
    column, prefix, scale = KEYS[key]
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    places = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.concat(F.lit(prefix), F.col(column)).alias("code")
    )
    daily = (
        items.join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("code", F.col("l_shipdate").cast("date").alias("d"))
        .agg(F.avg("l_extendedprice").alias("p"), F.sum("l_quantity").alias("volume"), F.count("*").alias("n"))
    )
    whole = Window.partitionBy("code")
    order = whole.orderBy("d")
    moved = daily.withColumn("r", scale * (F.col("p") / F.avg("p").over(whole) - 1))
    priced = moved.withColumn("close", 100 * F.exp(F.sum("r").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    opened = priced.withColumn("open", F.coalesce(F.lag("close").over(order), F.col("close")))
    spread = 0.002 * F.least("n", F.lit(5))
    return opened.select(
        "code",
        "d",
        "open",
        (F.greatest("open", "close") * (1 + spread)).alias("high"),
        (F.least("open", "close") * (1 - spread)).alias("low"),
        "close",
        "volume",
    )


def load_bars(spark: SparkSession, path: str, codes: list[str] | None = None, start: str | None = None,
              end: str | None = None, lookback_days: int = 0) -> DataFrame:
    """Bars of some codes and dates from Parquet: see ``select_bars``."""
    return select_bars(spark.read.parquet(path), codes, start, end, lookback_days)


def select_bars(bars: DataFrame, codes: list[str] | None = None, start: str | None = None, end: str | None = None,
                lookback_days: int = 0) -> DataFrame:
    """Bars with clean codes and numbers, of some codes and dates; the dates' filters reach the scan.

    ``lookback_days`` calendar days before ``start`` are read too, for
    warm-up. Codes are compared in upper case and without blanks around them.
    """
    if start is not None:
        bars = bars.where(F.col("d") >= F.date_sub(F.lit(start).cast("date"), lookback_days))
    if end is not None:
        bars = bars.where(F.col("d") <= F.lit(end).cast("date"))
    numbers = [clean(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")]
    rows = bars.select(F.upper(F.trim("code")).alias("code"), "d", *numbers)
    return rows if codes is None else rows.where(F.col("code").isin([c.strip().upper() for c in codes]))


def without(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows whose code isn't in ``excluded``."""
    return rows.join(excluded.select("code").distinct(), "code", "left_anti")


def instruments(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated text: ``code, list_date, end_date``; the first row of a code wins."""
    return parsed_instruments(spark.read.text(path).withColumn("line", F.monotonically_increasing_id()))


def parsed_instruments(lines: DataFrame) -> DataFrame:
    """``code, list_date, end_date`` from lines (value, line): the least line of a code counts; empty dates are NULL."""
    parts = F.split("value", "\t")
    rows = lines.select(
        F.upper(F.trim(parts[0])).alias("code"), F.try_to_date(F.get(parts, F.lit(1))).alias("list_date"),
        F.try_to_date(F.get(parts, F.lit(2))).alias("end_date"), "line",
    )
    return rows.groupBy("code").agg(*[F.min_by(c, "line").alias(c) for c in ("list_date", "end_date")])


def first_present(rows: DataFrame, names: list[str]) -> Column:
    """The first of several candidate columns that are there and not NULL."""
    present = [F.col(f"`{n}`") for n in names if n in rows.columns]
    return F.coalesce(*present) if present else F.lit(None)


def business_days(rows: DataFrame) -> DataFrame:
    """Every weekday from the first to the last day of ``rows`` (d)."""
    span = rows.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("d"))
    return days.where(F.dayofweek("d").between(2, 6))


def on_calendar(bars: DataFrame, days: DataFrame) -> DataFrame:
    """Each code on each day between its own first and last, close carried forward, volume not."""
    own = bars.groupBy("code").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    # Days of a code, not a product of all codes and days: each code spans its own dates.
    grid = own.select("code", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("d")).join(days, "d", "left_semi")
    carried = Window.partitionBy("code").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(bars.select("code", "d", "close", "volume"), ["code", "d"], "left").select(
        "code", "d", F.last("close", ignorenulls=True).over(carried).alias("close"), "volume"
    )


def snapshot_bars(quotes: DataFrame) -> DataFrame:
    """Quotes as bars: halted ones flat at the previous close, missing prices filled, high and low widened.

    ``quotes``: code, d, last, open, high, low, volume, pre_close.
    """
    blank = [(F.coalesce(c, F.lit(0.0)) == 0) for c in ("last", "open", "high", "low", "volume")]
    halted = blank[0] & blank[1] & blank[2] & blank[3] & blank[4] & (F.col("pre_close") > 0)
    close = F.when(halted, F.col("pre_close")).otherwise(F.col("last"))
    opened = F.when(halted, F.col("pre_close")).otherwise(F.coalesce("open", close))
    high = F.when(halted, F.col("pre_close")).otherwise(F.coalesce("high", F.greatest(opened, close)))
    low = F.when(halted, F.col("pre_close")).otherwise(F.coalesce("low", F.least(opened, close)))
    return quotes.where(close > 0).select(
        "code", "d", opened.alias("open"), F.greatest(high, opened, close).alias("high"),
        F.least(low, opened, close).alias("low"), close.alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"),
        halted.alias("halted"),
    )


def feature_series(spark: SparkSession, path: str) -> DataFrame:
    """``path, position, value`` of binary feature files: 32-bit floats, the first of them the position of the second."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                values = np.frombuffer(content, "<f4")
                if len(values) > 1:
                    at = int(values[0]) + np.arange(len(values) - 1)
                    yield pd.DataFrame({"path": name, "position": at, "value": values[1:].astype(float)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, position long, value double").withColumn("value", clean(F.col("value")))


def read_csv(spark: SparkSession, path: str, required: list[str] | None = None, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """A CSV with a header, in the first encoding that decodes all its names and values; ``required`` columns must be there."""
    for encoding in encodings:
        rows = spark.read.option("header", True).option("encoding", encoding).csv(path)
        odd = F.lit(False)
        for c in rows.columns:
            odd = odd | F.coalesce(F.col(f"`{c}`").contains("\ufffd"), F.lit(False))
        if not any("\ufffd" in c for c in rows.columns) and rows.where(odd).isEmpty():
            break
    missing = [c for c in required or [] if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return rows


def read_tables(spark: SparkSession, folder: str, columns: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Several CSVs of a folder by name, each with the columns it must have."""
    return {name: read_csv(spark, f"{folder}/{name}.csv", required) for name, required in columns.items()}


def read_config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """A JSON object from a file, over ``defaults``; unknown keys are an error."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    found = json.loads(text) if text.strip() else {}
    unknown = sorted(set(found) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | found


def fund_universe(funds: DataFrame, kinds: list[str], since: str, excluded: DataFrame, kept: DataFrame) -> DataFrame:
    """Funds (code, name, kind, list_date) of some kinds listed by a day and not excluded; codes in ``kept`` stay in any case."""
    clean_funds = funds.withColumn("code", F.upper(F.trim("code"))).where("code <> ''")
    passed = F.col("kind").isin(kinds) & (F.col("list_date") <= F.lit(since).cast("date"))
    drop, always = excluded.select("code", F.lit(True).alias("_out")).distinct(), kept.select("code", F.lit(True).alias("_in")).distinct()
    joined = clean_funds.join(drop, "code", "left").join(always, "code", "left")
    return joined.where(F.col("_in").isNotNull() | (F.coalesce(passed, F.lit(False)) & F.col("_out").isNull())).drop("_in", "_out")
