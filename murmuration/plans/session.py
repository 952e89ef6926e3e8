"""Sessions and the folder that checkpoints go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "murmuration", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; everything else is the cluster's."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ensure_checkpoint(spark: SparkSession) -> None:
    """checkpoint() writes to spark.checkpoint.dir; only where nothing is set and the master is local (tests) a temporary folder is."""
    if not spark.sparkContext.getCheckpointDir():
        if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="murmuration-"))


def work_table(spark: SparkSession) -> str:
    """A fresh place for a table in the shared folder of checkpoints."""
    ensure_checkpoint(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
