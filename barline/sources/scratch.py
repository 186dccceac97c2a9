"""Tables that a job writes once and reads in several branches, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def held(df: DataFrame) -> DataFrame:
    """``df``, written now and read back: its branches don't derive it again, and a lost executor repeats one stage at most.

    The folder is that of ``spark.checkpoint.dir``; where it is unset, only a local master gets a folder of its own.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='barline-')}"
    path = f"{base.rstrip('/')}/barline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
