"""Session settings the operators are written for."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Folders of the open `temporary_tables` blocks, the innermost last.
_owners: list[str] = []


def build_session(app_name: str = "reviewlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC timestamps.

    ``master`` and resource sizes normally come from spark-submit; pass them for local runs only.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        cpus = master.partition("[")[2].rstrip("]")
        parts = cpus if cpus.isdigit() else str(os.cpu_count() or 8)
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", parts)
            .config("spark.ui.enabled", "false")
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder, visible to all executors.

    The folder is the one ``spark.checkpoint.dir`` names. Where none is set, a local session takes a
    temporary folder; on a cluster, whose executors would not share it, this fails.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="reviewlens-checkpoint-"))
    name = f"reviewlens-{uuid.uuid4().hex}"
    return f"{_owners[-1]}/{name}" if _owners else f"{context.getCheckpointDir()}/{name}"


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables written inside the block when it ends.

    Results are lazy and read them: collect or write results before the block ends.
    """
    path = shared_folder(spark)
    _owners.append(path)
    try:
        yield
    finally:
        _owners.remove(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
