"""Results that several passes read: kept in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint: lineage ends there. The folder is spark.checkpoint.dir; where that is unset, a temporary
    one serves a local master, and a cluster, whose executors would not see it, gets an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="rillmark-")
        context.setCheckpointDir(base)
    return df.checkpoint()
