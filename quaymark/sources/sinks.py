"""Writes that may be repeated: upserts, day and month partitions, frozen tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; a new row replaces the old one of its key."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_seq")))
    return both.withColumn("_n", n).where("_n = 1").drop("_n", "_seq")


def write_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that ``rows`` holds; a repeated write changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def freeze(rows: DataFrame, path: str) -> None:
    """Write once; a second write fails."""
    rows.write.mode("errorifexists").parquet(path)


def backfill(ledger: DataFrame, found: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The ledger with empty cells filled from ``found`` and new rows added; filled cells never change."""
    fresh = found.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    joined = ledger.join(fresh, keys, "full")
    return joined.select(*keys, *[F.coalesce(v, f"_{v}").alias(v) for v in values])


def semi_text(lines: DataFrame, codes: DataFrame) -> DataFrame:
    """Lines of a tab-separated text whose first field is one of ``codes``."""
    return lines.withColumn("code", F.upper(F.trim(F.split("value", "\t")[0]))).join(codes.select("code").distinct(), "code", "left_semi").select("value")


def merge_latest(batches: list[DataFrame], keys: list[str], sequence: str) -> DataFrame:
    """The rows of all batches, of each key that of the greatest ``sequence``; columns that a batch lacks are NULL."""
    rows = batches[0]
    for batch in batches[1:]:
        rows = rows.unionByName(batch, allowMissingColumns=True)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(sequence)))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def export_mapping(codes: DataFrame, extra: DataFrame, path: str, names: dict[str, str]) -> None:
    """Write a slim table of codes with columns of ``extra`` under new names beside it, in order of the codes."""
    joined = codes.select("code").distinct().join(extra.select("code", *names), "code", "left")
    joined.select("code", *[F.coalesce(F.col(old).cast("string"), F.lit("")).alias(new) for old, new in names.items()]).orderBy("code").write.mode("overwrite").option("header", True).csv(path)
