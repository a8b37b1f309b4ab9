"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else the context's checkpoint folder, else, where driver and executors are one
    process on one machine, a folder of our own. On a cluster a folder of the driver's machine would be another one on
    each executor, so there the setting is asked for."""
    context = spark.sparkContext
    at = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (at.get() if at.isDefined() else None)
    if not folder:
        if not one_process(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="weirflow-")
    if at.isEmpty():
        context.setCheckpointDir(folder)
    return folder


def one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/weirflow/{name}-{uuid.uuid4().hex}"
