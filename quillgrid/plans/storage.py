"""Stored intermediate tables, so that a table used several times is worked out once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in ``spark.checkpoint.dir``; only a local master may do without that setting."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillgrid-"))
    return df.checkpoint(eager=True)
