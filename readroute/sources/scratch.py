"""Folders for what a run writes on its way, where all executors see it."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only a session on one machine (tests, a laptop) may leave it unset and gets a folder
    of its own, below the warehouse folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{top.rstrip('/')}/readroute-{uuid.uuid4().hex}"
