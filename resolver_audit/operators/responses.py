"""Row-level operators on responses: filters, answer profiles, rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resolver_audit.functions.answers import (
    addresses,
    answer_records,
    bounds_of,
    is_ipv4,
    last_ttl,
    several_ttls,
)
from resolver_audit.sources.dns_log import LONG_LAYOUT_FIELDS, SHORT_LAYOUT_FIELDS


def is_recursive_success() -> Column:
    """Whether a response successfully answers a recursive query."""
    return (F.col("rcode") == "NOERROR") & (F.col("rd") == "1") & (F.col("ra") == "1")


def recursive_success(responses: DataFrame) -> DataFrame:
    """Successful answers to recursive queries, with the case-folded name as ``domain``."""
    return responses.filter(is_recursive_success()).withColumn("domain", F.lower("qname"))


def with_answer_profile(responses: DataFrame) -> DataFrame:
    """Adds the profile of the answer field ``dans``.

    ``sips`` are the distinct addresses, ``n_servers`` their number, ``nip`` the
    number of address records with repeats, ``clen`` the number of all other
    records (CNAMEs, IPv6 addresses, blanks).

    Records and addresses are generated, not projected: filters on the profile then
    stay above them, and an answer is taken apart once instead of once per predicate.
    """
    split = responses.select("*", _generated(answer_records(F.col("dans"))).alias("_records"))
    found = split.select("*", _generated(addresses(F.col("_records"))).alias("_addresses"))
    return (
        found.withColumn("sips", F.array_distinct("_addresses"))
        .withColumn("nip", F.size("_addresses").cast("bigint"))
        .withColumn("clen", (F.size("_records") - F.size("_addresses")).cast("bigint"))
        .withColumn("n_servers", F.size("sips").cast("bigint"))
        .drop("_records", "_addresses")
    )


def _generated(value: Column) -> Column:
    """``value`` as the one row of a generator."""
    return F.explode(F.array(value))


def with_ttls(responses: DataFrame) -> DataFrame:
    """Adds ``ttl_last`` (null: not an integer) and ``ttl_min``, ``ttl_max`` (null: one is not).

    Lists of several TTLs are taken apart once, in a column of their own.
    """
    text = F.col("danttls")
    low, high = bounds_of(F.col("_ttls"), F.col("ttl_last"))
    listed = responses.withColumns({"ttl_last": last_ttl(text), "_ttls": several_ttls(text)})
    return listed.withColumns({"ttl_min": low, "ttl_max": high}).drop("_ttls")


def records_of(responses: DataFrame) -> DataFrame:
    """One row per answer record: ``id, pos, record, is_ipv4``."""
    return responses.select(
        "id", F.posexplode(answer_records(F.col("dans"))).alias("pos", "record")
    ).withColumn("is_ipv4", is_ipv4(F.col("record")))


def with_addresses_only(profiled: DataFrame) -> DataFrame:
    """Responses that return at least one IPv4 address."""
    return profiled.filter(F.col("nip") > 0)


def rejected_rows(parsed: DataFrame) -> DataFrame:
    """Number of lines left out, by ``reason``.

    ``field_count``: neither layout. The other reasons concern successful
    recursive responses with an address: ``last_ttl`` keeps a response out of the
    (resolver, domain) profile, ``any_ttl`` out of the (resolver, network)
    profile, ``empty_name`` out of the learned samples.
    """
    laid_out = F.col("n_fields").isin(SHORT_LAYOUT_FIELDS, LONG_LAYOUT_FIELDS)
    profiled = with_ttls(with_answer_profile(parsed))
    judged = laid_out & is_recursive_success() & (F.col("nip") > 0)
    reasons = {
        "field_count": ~laid_out,
        "last_ttl": judged & F.col("ttl_last").isNull(),
        "any_ttl": judged & F.col("ttl_min").isNull(),
        "empty_name": judged & (F.col("qname") == ""),
    }
    counts = profiled.agg(*[F.count_if(test).alias(reason) for reason, test in reasons.items()])
    return counts.unpivot([], list(reasons), "reason", "n")


def rejected_of(malformed: DataFrame, network_rows: DataFrame) -> DataFrame:
    """The same from a condensed log: its malformed lines, and its messages by network."""
    judged = network_rows.filter((F.col("nip") > 0) & F.col("lead"))
    counts = judged.agg(
        F.sum(F.col("n") - F.col("n_last")).alias("last_ttl"),
        F.sum(F.col("n") - F.col("n_valid")).alias("any_ttl"),
        F.sum(F.when(F.col("qname") == "", F.col("n"))).alias("empty_name"),
    ).unpivot([], ["last_ttl", "any_ttl", "empty_name"], "reason", "n")
    lines = malformed.agg(F.sum("n").alias("n")).select(F.lit("field_count").alias("reason"), "n")
    return lines.unionByName(counts).na.fill(0, ["n"])
