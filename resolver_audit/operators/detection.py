"""Detection: unusual pairs, learned thresholds, confirmed manipulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resolver_audit.functions.names import second_level_domain
from resolver_audit.operators.profiles import (
    CATEGORICAL,
    LINK,
    PAIR,
    domain_features,
)
from resolver_audit.operators.skew import join_hot
from resolver_audit.operators.thresholds import (
    DIGITS,
    percentile_summary,
    res_dom_max_ttl,
    ttl_fence,
    unusual_values,
)
from resolver_audit.settings import AuditSettings

# The order in which anomaly types are listed.
TYPE_ORDER = ("ttl", "clen", "nip", "asn")


def ttl_anomalies(ranges: DataFrame, fences: DataFrame) -> DataFrame:
    """Pairs all of whose TTLs lie above the fence of their domain.

    All lie above exactly when the smallest does.
    """
    return (
        join_hot(ranges, fences, ["domain"])
        .filter(F.col("min_ttl") > F.col("fence"))
        .select(*PAIR, F.lit("ttl").alias("feature"))
    )


def feature_anomalies(counters: DataFrame, unusual: DataFrame) -> DataFrame:
    """Pairs all of whose values of a feature are unusual.

    Only the unusual values are joined; a pair is cleared by any value without a
    partner.
    """
    marked = join_hot(
        counters.filter(F.col("feature").isin(*CATEGORICAL)),
        unusual.withColumn("_unusual", F.lit(True)),
        ["domain", "feature", "value"],
        "left",
    )
    return (
        marked.groupBy(*PAIR, "feature")
        .agg(F.bool_and(F.coalesce("_unusual", F.lit(False))).alias("all_unusual"))
        .filter("all_unusual")
        .select(*PAIR, "feature")
    )


def anomalies_res_dom(flagged: DataFrame) -> DataFrame:
    """One row per flagged pair with its anomaly ``types`` in fixed order."""
    found = [F.max(F.col("feature") == name) for name in TYPE_ORDER]
    types = F.array_compact(
        F.array(*[F.when(test, F.lit(name)) for name, test in zip(TYPE_ORDER, found)])
    )
    return flagged.groupBy(*PAIR).agg(types.alias("types"))


def of_considered(rows: DataFrame, considered: DataFrame) -> DataFrame:
    """Rows of the domains that are resolved often enough to judge, dealt by (domain, place)."""
    return join_hot(rows, considered.select("domain"), ["domain"])


def find_anomalies_res_dom(
    counters: DataFrame, ranges: DataFrame, settings: AuditSettings
) -> DataFrame:
    """Flagged pairs from the counters and TTL ranges of considered domains.

    ``counters`` need not be summed. What is normal for a domain is found on counts of
    (domain, value), which are added up before anything is placed by domain.
    """
    unusual = unusual_values(domain_features(counters))
    fences = ttl_fence(res_dom_max_ttl(ranges, settings.ttl_granularity), settings)
    flagged = ttl_anomalies(ranges, fences).unionByName(feature_anomalies(counters, unusual))
    return anomalies_res_dom(flagged)


def unflagged(rows: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Rows with an address whose (resolver, domain) pair is not flagged."""
    return rows.filter(F.col("asn").isNotNull()).join(
        anomalies.select(*PAIR), PAIR, "left_anti"
    )


def network_slds(normal_rows: DataFrame) -> DataFrame:
    """Returned addresses per network label, raw label and second-level domain."""
    return (
        normal_rows.select(
            "asn",
            "asn_raw",
            second_level_domain(F.col("domain")).alias("sld"),
            (F.col("n") * F.col("n_ips")).alias("n"),
        )
        .filter(F.col("sld").isNotNull())
        .groupBy("asn", "asn_raw", "sld")
        .agg(F.sum("n").alias("n"))
    )


def sld_per_asn(slds: DataFrame) -> DataFrame:
    """Distinct second-level domains per network label."""
    return slds.groupBy("asn").agg(F.countDistinct("sld").alias("n_sld"))


def count_per_asn_sld(slds: DataFrame) -> DataFrame:
    """Returned addresses per (raw network label, second-level domain)."""
    return slds.groupBy("asn_raw", "sld").agg(F.sum("n").alias("n"))


def learn_params(slds: DataFrame) -> DataFrame:
    """Percentile summaries of both samples: rows ``param, pct, value``."""
    per_asn = percentile_summary(sld_per_asn(slds), "n_sld")
    per_sld = percentile_summary(count_per_asn_sld(slds), "n")
    columns = ["param", "pct", "value"]
    return (
        per_asn.withColumn("param", F.lit("sld_asn"))
        .select(*columns)
        .unionByName(per_sld.withColumn("param", F.lit("sld_count")).select(*columns))
    )


def threshold(params: DataFrame, param: str, pct: int) -> Column:
    """One learned value as a scalar subquery; null when its sample was empty."""
    return (
        params.filter((F.col("param") == param) & (F.col("pct") == pct))
        .agg(F.round(F.max("value"), DIGITS).alias("value"))
        .scalar()
    )


def suspicious_res_asn(
    links: DataFrame, params: DataFrame, percentile_pick: int = 50
) -> DataFrame:
    """(resolver, network) with many second-level domains, many responses each, constant answers.

    ``links`` has ``resolver, asn, n, n_sld, fixed`` as ``link_profile`` returns them.
    """
    per_sld = F.round(F.col("n") / F.nullif(F.col("n_sld"), F.lit(0)), DIGITS)
    return links.filter(
        (F.size("fixed") > 1)
        & (per_sld > threshold(params, "sld_count", percentile_pick))
        & (F.col("n_sld") > threshold(params, "sld_asn", percentile_pick))
    )


def without_tags(anomalies: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """Flagged pairs whose type list contains none of ``tags``."""
    text = F.array_join("types", ":")
    for tag in tags:
        anomalies = anomalies.filter(~F.contains(text, F.lit(tag)))
    return anomalies


def confirmed_pairs(
    names: DataFrame, suspicious: DataFrame, anomalies: DataFrame
) -> DataFrame:
    """Flagged pairs answered with an address of a suspicious network: ``resolver, domain, asn``.

    ``names`` has the names asked per (resolver, network) in column ``domain``; the
    flagged pairs are case-folded, so names in another spelling do not match.
    """
    return (
        names.join(anomalies.select(*PAIR), PAIR, "left_semi")
        .join(suspicious.select(*LINK), LINK, "left_semi")
        .select(*PAIR, "asn")
        .distinct()
    )


def evidence(suspicious: DataFrame, servers: DataFrame) -> DataFrame:
    """The address list and fixed features of each suspicious (resolver, network)."""
    return suspicious.join(servers, LINK).select(
        *LINK, "servers", F.array_join("fixed", ":").alias("fixed_features")
    )


def anomalies_res_asn(confirmed: DataFrame, evidence: DataFrame) -> DataFrame:
    """Confirmed pairs with the addresses and fixed features of their network."""
    return confirmed.join(evidence, LINK).select(
        "resolver", "domain", "asn", "servers", "fixed_features"
    )
