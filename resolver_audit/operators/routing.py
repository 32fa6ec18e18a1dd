"""Longest-prefix match of addresses against the ASN view, as equi-joins on (network, prefix_len).

A view counted to be at most BROADCAST prefixes is sent out, each prefix once, and the rows look
up their network at each prefix length that occurs in it, the longest first, without being shuffled.
For a larger one, every distinct address is paired with its networks at these lengths, joined
to the view and keeps its longest match; the labels then go back to the rows by address, and
which side is broadcast is Spark's choice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resolver_audit.functions.networks import ip_number, network_label, raw_network_label


def _network(number: Column, prefix_len: Column) -> Column:
    """First address of the network of a length that an address lies in."""
    return number - number % F.pow(F.lit(2), F.lit(32) - prefix_len).cast("bigint")


#: Prefixes of a view that is sent to every executor.
BROADCAST = 1_000_000


@dataclass(frozen=True)
class Routes:
    """An ASN view, the prefix lengths that occur in it (at most 33 numbers) and its prefixes."""

    view: DataFrame
    lengths: tuple[int, ...]
    size: int

    @classmethod
    def of(cls, view: DataFrame) -> Routes:
        """Collects the lengths and their counts with one small job."""
        found = {r.prefix_len: r["count"] for r in view.groupBy("prefix_len").count().collect()}
        return cls(view, tuple(sorted(found)), sum(found.values()))

    @property
    def prefixes(self) -> DataFrame:
        return self.view.select(
            F.col("prefix_len").cast("int").alias("prefix_len"),
            _network(F.col("network"), F.col("prefix_len")).alias("network"),
            "asn",
        )


def longest_match(numbers: DataFrame, routes: Routes) -> DataFrame:
    """``_number, _route_asn`` of the distinct addresses in column ``_number`` that the view covers."""
    lengths = F.array(*[F.lit(n) for n in routes.lengths]).cast("array<int>")
    candidates = (
        numbers.filter(F.col("_number").isNotNull())
        .distinct()
        .select("_number", F.explode(lengths).alias("prefix_len"))
        .withColumn("network", _network(F.col("_number"), F.col("prefix_len")))
    )
    return (
        candidates.join(routes.prefixes, ["network", "prefix_len"])
        .groupBy("_number")
        .agg(F.max_by("asn", "prefix_len").alias("_route_asn"))
    )


def _signed(network: Column) -> Column:
    """An address as an int: with a length it makes a key of 64 bits, which Spark looks up as one number."""
    return (network - (1 << 31)).cast("int")


def _looked_up(numbered: DataFrame, routes: Routes) -> DataFrame:
    """Adds ``_route_asn`` from a broadcast view. Each join finds one network at most, so rows stay as many."""
    single = routes.prefixes.groupBy(_signed(F.col("network")).alias("network"), "prefix_len").agg(
        F.struct(F.max("asn").alias("asn")).alias("_route")
    )
    number, found = F.col("_number"), []
    for length in reversed(routes.lengths):
        found.append(f"_route_{length}")
        network = _signed(_network(number, F.lit(length)))
        asked = {"network": network, "prefix_len": F.when(number.isNotNull(), F.lit(length))}
        prefixes = F.broadcast(single.filter(F.col("prefix_len") == length).withColumnRenamed("_route", found[-1]))
        numbered = numbered.withColumns(asked).join(prefixes, ["network", "prefix_len"], "left").drop(*asked)
    route = F.coalesce(*found)["asn"] if found else F.lit(None).cast("string")
    return numbered.withColumn("_route_asn", route)


def _matched(numbered: DataFrame, routes: Routes) -> DataFrame:
    """Adds ``_route_asn`` by the distinct addresses.

    Rows without an address to look up join on negative numbers by their hash, so that they do not
    meet in one task.
    """
    matched = longest_match(numbered.select("_number"), routes).withColumnRenamed("_number", "_matched")
    spread = -1 - F.pmod(F.xxhash64(*numbered.columns), F.lit(1 << 20))
    return numbered.join(matched, F.coalesce("_number", spread) == F.col("_matched"), "left")


def with_networks(rows: DataFrame, routes: Routes) -> DataFrame:
    """Adds ``asn`` and ``asn_raw``, the labels of column ``ip`` (null for a null address)."""
    numbered = rows.withColumn("_number", ip_number(F.col("ip")))
    labelled = (_looked_up if routes.size <= BROADCAST else _matched)(numbered, routes)
    ip, route, has_lookup = F.col("ip"), F.col("_route_asn"), F.col("_number").isNotNull()
    return labelled.withColumns(
        {
            "asn": network_label(ip, route, has_lookup),
            "asn_raw": raw_network_label(ip, route, has_lookup),
        }
    ).select(*rows.columns, "asn", "asn_raw")
