"""The ASN view: IPv4 prefix to autonomous system number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resolver_audit.functions.networks import ip_number


def asn_view(prefixes: DataFrame) -> DataFrame:
    """``network`` (dotted), ``prefix_len``, ``asn`` as (bigint, int, string)."""
    return prefixes.select(
        ip_number(F.col("network")).alias("network"),
        F.col("prefix_len").cast("int").alias("prefix_len"),
        F.col("asn").cast("string").alias("asn"),
    ).filter(F.col("network").isNotNull() & F.col("prefix_len").between(0, 32))


def read_asn_view(spark: SparkSession, path: str) -> DataFrame:
    """A tab separated ``prefix/length  asn`` file; lines starting with ``;`` are comments."""
    rows = spark.read.csv(path, sep="\t", comment=";", schema="prefix string, asn string")
    return asn_view(
        rows.select(
            F.substring_index("prefix", "/", 1).alias("network"),
            F.substring_index("prefix", "/", -1).try_cast("int").alias("prefix_len"),
            "asn",
        )
    )
