"""Intermediate tables and files in the folder that driver and executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from functools import cache
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _own_folder() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="corpus-")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``.

    Only a local session (one process, as in tests) without that setting gets a folder of
    its own; on a cluster without it this is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
        root = _own_folder().name
    return f"{root}/{what}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, what: str) -> DataFrame:
    """The frame written as Parquet and read again: cut lineage that outlives lost executors."""
    spark = frame.sparkSession
    path = shared_folder(spark, what)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def free_name(taken: list[str], name: str) -> str:
    """The name, with underscores until no column is called so in any case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder, for tasks that write their own file format."""
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder)


@cache
def _code() -> str:
    """This package as a zip file that lives as long as the process."""
    package = Path(__file__).resolve().parents[1]
    target = Path(_own_folder().name) / f"{package.name}-code"
    return shutil.make_archive(str(target), "zip", package.parent, package.name)


def ship_code(spark: SparkSession) -> None:
    """Makes this package importable in Python workers that do not have it on their path."""
    home = str(Path(__file__).resolve().parents[2])
    if home in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    if not any(name.endswith("-code.zip") for name in spark.sparkContext.listFiles):
        spark.sparkContext.addPyFile(_code())


#: Bytes of a batch of rows that a task hands to Python at once.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session does so itself.

    Spark's own bound is 10,000 rows or 64 MB: such a batch of long texts is held by the task and its
    Python worker, outside the heap, in buffers of up to twice its size. Spark reads the setting when a
    frame is run, so it stays set.
    """
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)


#: A side of a join is broadcast explicitly only when it has been counted to be this small.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(frame: DataFrame) -> DataFrame:
    """For stored frames of a few numbers a row: broadcast up to BROADCAST_ROWS rows, else Spark's own choice."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame
