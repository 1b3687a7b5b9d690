"""Cutting lineage in loops, with reliable checkpoints in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session gets a temporary one."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not named and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="recordloom-ckpt-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def shared_path(spark, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
