"""Long counter tables as Parquet, clustered by their key, for steps that follow each other.

A folder holds the rows in buckets by key (``rows``) and what a reader has to know of them
(``spec``). Read again, the table is joined and aggregated by its key without being
shuffled. Names keep every character; no cell holds a list.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _name() -> str:
    return f"clustered_{uuid.uuid4().hex}"


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_clustered(table: DataFrame, path: str, keys: list[str], buckets: int | None = None) -> None:
    """Writes ``table`` in buckets by ``keys``: as many as there are shuffle partitions unless given."""
    spark, name = table.sparkSession, _name()
    buckets = buckets or _buckets(spark)
    # Dealt as the buckets are, so that a bucket is one sorted file.
    dealt = table.repartition(buckets, *keys)
    writer = dealt.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite")
    writer.option("path", f"{path}/rows").format("parquet").saveAsTable(name)
    # Only the catalog's entry goes: the files are the table's own only by their path.
    spark.sql(f"DROP TABLE {name}")
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in table.schema.fields)
    spec = json.dumps({"columns": columns, "keys": keys, "buckets": buckets})
    spark.range(1).select(F.lit(spec).alias("value")).write.mode("overwrite").text(f"{path}/spec")


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    """The table in its buckets."""
    spec = json.loads(spark.read.text(f"{path}/spec").filter("value != ''").first().value)
    name, keys = _name(), ", ".join(f"`{key}`" for key in spec["keys"])
    location = f"{path}/rows".replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({spec['columns']}) USING parquet CLUSTERED BY ({keys}) "
        f"SORTED BY ({keys}) INTO {spec['buckets']} BUCKETS LOCATION '{location}'"
    )
    return spark.table(name)
