"""What a job needs from its Spark session."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(package)
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="run-"), name),
        "zip",
        root_dir=os.path.dirname(package),
        base_dir=name,
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared checkpoint folder.

    Without that setting only a session on one machine, as in a test, gets a
    folder: executors elsewhere would not find what others wrote.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = shared or tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/qaprep/{name}-{uuid.uuid4().hex}"
