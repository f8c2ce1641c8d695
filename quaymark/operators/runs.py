"""Runs of equal labels and of true flags (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions import windows as w


def run_length(rows: DataFrame, flag: str, name: str) -> DataFrame:
    """Add ``name``: how many true rows in a row end here; 0 where ``flag`` isn't true."""
    true = F.coalesce(F.col(flag), F.lit(False))
    island = rows.withColumn("_island", F.sum((~true).cast("int")).over(w.so_far()))
    inside = Window.partitionBy("code", "_island").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn(name, F.sum(true.cast("int")).over(inside).cast("long")).drop("_island")


def with_run(rows: DataFrame, label: str) -> DataFrame:
    """Add ``run_no``, 1 for the first run of equal labels of a code (NULL equals NULL)."""
    changed = ~F.col(label).eqNullSafe(F.lag(label).over(w.by_code())) | (w.bar_no() == 1)
    return rows.withColumn("run_no", F.sum(changed.cast("int")).over(w.so_far()).cast("long"))


def segments(rows: DataFrame, label: str) -> DataFrame:
    """One row for each run: ``code, run_no, label, start_d, end_d, n, first_close, last_close, ret``."""
    found = with_run(rows, label).groupBy("code", "run_no").agg(
        F.first(label).alias("label"),
        F.min("d").alias("start_d"),
        F.max("d").alias("end_d"),
        F.count("*").alias("n"),
        F.min_by("close", "d").alias("first_close"),
        F.max_by("close", "d").alias("last_close"),
    )
    return found.withColumn("ret", F.col("last_close") / F.col("first_close") - 1)


def first_of_run(rows: DataFrame, label: str) -> DataFrame:
    """The rows where the label differs from the one before."""
    return rows.withColumn("_before", F.lag(label).over(w.by_code())).where(
        ~F.col(label).eqNullSafe(F.col("_before"))
    ).drop("_before")


def cluster_events(rows: DataFrame, flag: str, gap: int = 5) -> DataFrame:
    """True rows at most ``gap`` rows apart join one event: ``code, event_no, onset, end_d, n``.

    Distances count all rows of the code.
    """
    numbered = rows.withColumn("_no", w.bar_no()).where(F.coalesce(F.col(flag), F.lit(False)))
    new = F.coalesce(F.col("_no") - F.lag("_no").over(w.by_code()) > gap, F.lit(True))
    events = numbered.withColumn("_new", new).withColumn(
        "event_no", F.sum(F.col("_new").cast("int")).over(w.so_far()).cast("long")
    )
    return events.groupBy("code", "event_no").agg(
        F.min("d").alias("onset"), F.max("d").alias("end_d"), F.count("*").alias("n")
    )


def majority(rows: DataFrame, label: str, n: int, name: str) -> DataFrame:
    """Add the most frequent of the last n labels; ties go to the first in alphabetical order."""
    held = F.collect_list(label).over(w.last_rows(n))

    def better(best: Column, x: Column) -> Column:
        times = F.size(F.filter("_held", lambda y: y == x))
        return F.when(times > best["n"], F.struct(times.alias("n"), x.alias("label"))).otherwise(best)

    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("label"))
    counted = rows.withColumn("_held", held)
    best = F.aggregate(F.array_sort(F.array_distinct("_held")), start, better, lambda b: b["label"])
    return counted.withColumn(name, best).drop("_held")
