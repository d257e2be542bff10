"""Storing frames in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

from millrace.errors import Invalid


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one of this machine is set only in local mode, where that is shared."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise Invalid("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut, kept where every executor can read it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
