"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def shared_folder(df: DataFrame) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Only a local session may name none; it gets a temporary one."""
    context = df.sparkSession.sparkContext
    if not (known := context._jsc.sc().getCheckpointDir()).isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[[^-]*\])?$", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there."""
    shared_folder(df)
    return df.checkpoint(eager=True)
