"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="resolver-audit-")


def staging_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    A local session without one gets a temporary folder that lives as long as the
    process; on a cluster, where such a folder would not be shared, it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.conf.get("spark.master", "").startswith("local"):
        return _local_folder().name
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


class Staging:
    """Writes a DataFrame once and hands back the stored table.

    Later stages read only the columns they use, see the true size of the table
    when they pick a join, and do not depend on executors that computed it.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{staging_root(spark)}/resolver-audit-{uuid.uuid4().hex}"

    def keep(self, name: str, frame: DataFrame, *partition_by: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        frame.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)
