"""Whole frames: keeping results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows to the folder that ``spark.checkpoint.dir`` names, and go on from there.

    Where it is unset, a temporary folder is chosen in local mode; on a cluster that is an error."""
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quantloom-"))
    return df.checkpoint(eager=True)
