"""Cutting the lineage of tables that a loop builds on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written below the session's checkpoint folder and read from there.

    The folder is ``spark.checkpoint.dir``. Where it is unset, a local master
    gets a temporary one; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quaymark-')}"
        context.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
