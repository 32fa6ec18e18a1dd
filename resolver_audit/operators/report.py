"""The final report: statistics of every resolver and its confirmed manipulations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published column names, and what stands for no manipulation.
REPORT_COLUMNS = [
    "resolver",
    "queried_domains",
    "count",
    "clients",
    "asn",
    "domains",
    "servers",
]
NOTHING = "-"


def manipulations(anomalies: DataFrame) -> DataFrame:
    """Confirmed pairs grouped to one row per (resolver, network), lists sorted."""
    return anomalies.groupBy("resolver", "asn").agg(
        F.array_join(F.sort_array(F.collect_set("domain")), ":").alias("domains"),
        F.array_join(F.sort_array(F.collect_set("servers")), ":").alias("servers"),
    )


def manipulations_of(confirmed: DataFrame, evidence: DataFrame) -> DataFrame:
    """The same from confirmed pairs and their evidence: the address list is resolved once per network."""
    domains = confirmed.groupBy("resolver", "asn").agg(
        F.array_join(F.sort_array(F.collect_set("domain")), ":").alias("domains")
    )
    return domains.join(evidence.select("resolver", "asn", "servers"), ["resolver", "asn"])


def report_rows(stats: DataFrame, manipulated: DataFrame) -> DataFrame:
    """One row per resolver and manipulating network, ``-`` where there is none."""
    return (
        stats.join(manipulated, "resolver", "left")
        .na.fill(NOTHING, ["asn", "domains", "servers"])
        .select(*REPORT_COLUMNS)
    )


def in_report_order(rows: DataFrame) -> DataFrame:
    """Most queried resolvers first; ties by every further key, descending."""
    keys = ["queried_domains", "resolver", "count", "clients", "asn"]
    return rows.orderBy(*[F.desc(key) for key in keys])


def final_report(stats: DataFrame, manipulated: DataFrame) -> DataFrame:
    """The report in its published order."""
    return in_report_order(report_rows(stats, manipulated))
