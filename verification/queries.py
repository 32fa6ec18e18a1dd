"""One query per operator, each over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resolver_audit.functions.answers import all_ttls, last_ttl
from resolver_audit.functions.fields import split_fields as fields_of
from resolver_audit.functions.names import second_level_domain
from resolver_audit.operators import detection, profiles, thresholds
from resolver_audit.operators import responses as rows
from resolver_audit.operators.routing import Routes, with_networks
from resolver_audit.plans.audit import Audit
from resolver_audit.plans.staging import Staging
from resolver_audit.sources import interchange
from resolver_audit.sources.asn_view import read_asn_view
from resolver_audit.sources.dns_log import parse_lines, read_log, well_formed
from verification.tables import ODD_NAME, VIEW_LINES_SQL, dns_lines, dns_log, table, view

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def lazy_audit(spark: SparkSession, sf_dir: str) -> Audit:
    """For results that use the condensed log once."""
    return Audit(dns_log(spark, sf_dir), view(spark))


def staged_audit(spark: SparkSession, sf_dir: str, once: tuple[str, ...] = ()) -> Audit:
    """For results that use it more than once, but for tables that they use ``once``."""
    return Audit(dns_log(spark, sf_dir), view(spark), staging=Staging(spark), once=once)


def joined(items: Column | str) -> Column:
    return F.array_join(items, ":")


# Rows of the log.


@query
def split_fields(spark, sf_dir):
    fields = fields_of(F.col("line"))
    return dns_lines(spark, sf_dir).select(
        "id", F.size(fields).cast("bigint").alias("n_fields"), F.array_join(fields, "\t").alias("fields")
    )


@query
def dns_responses(spark, sf_dir):
    parsed = well_formed(parse_lines(dns_lines(spark, sf_dir), "line"))
    return rows.recursive_success(parsed)


@query
def rejected_rows(spark, sf_dir):
    return rows.rejected_rows(parse_lines(dns_lines(spark, sf_dir), "line"))


@query
def answer_records(spark, sf_dir):
    records = rows.records_of(rows.recursive_success(dns_log(spark, sf_dir)))
    return records.withColumn("pos", F.col("pos").cast("bigint")).withColumn(
        "is_ipv4", F.col("is_ipv4").cast("int")
    )


@query
def answer_profile(spark, sf_dir):
    profiled = rows.with_answer_profile(rows.recursive_success(dns_log(spark, sf_dir)))
    return rows.with_addresses_only(profiled).select(
        "id", "clen", "nip", joined(F.sort_array("sips")).alias("sips")
    )


@query
def answer_profile_asn(spark, sf_dir):
    profiled = rows.with_answer_profile(rows.recursive_success(dns_log(spark, sf_dir)))
    return profiled.select(
        "id", F.col("clen").alias("cnames"), "n_servers", joined(F.sort_array("sips")).alias("sips")
    )


@query
def ttl_last(spark, sf_dir):
    last = last_ttl(F.col("danttls"))
    return dns_log(spark, sf_dir).select("id", last.alias("ttl_last"))


@query
def ttl_all(spark, sf_dir):
    ttls = dns_log(spark, sf_dir).select("id", all_ttls(F.col("danttls")).alias("ttls"))
    ok = ~F.exists("ttls", lambda ttl: ttl.isNull())
    return ttls.select(
        "id",
        F.array_join(F.transform("ttls", lambda t: t.cast("string")), ",", "?").alias("ttls"),
        ok.cast("int").alias("ttls_ok"),
    )


# Names and networks.


@query
def sld(spark, sf_dir):
    names = dns_log(spark, sf_dir).select(F.col("qname").alias("name")).distinct()
    return names.withColumn("sld", second_level_domain(F.col("name")))


@query
def sld_pages(spark, sf_dir):
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    return (
        table(spark, sf_dir, "pages")
        .select(second_level_domain(host).alias("sld"))
        .groupBy("sld")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def labelled_addresses(spark, sf_dir) -> DataFrame:
    profiled = rows.with_answer_profile(rows.recursive_success(dns_log(spark, sf_dir)))
    distinct = profiled.select(F.explode("sips").alias("ip")).distinct()
    return with_networks(distinct, Routes.of(view(spark)))


@query
def ip_asn(spark, sf_dir):
    return labelled_addresses(spark, sf_dir).select("ip", "asn")


@query
def ip_asn_raw(spark, sf_dir):
    return labelled_addresses(spark, sf_dir).select("ip", "asn_raw")


# Profiles per (resolver, domain) and per domain.


def judged(rows_: DataFrame) -> DataFrame:
    return profiles.judged_pairs(rows_)


@query
def res_dom_counts(spark, sf_dir):
    return profiles.res_dom_counts(judged(lazy_audit(spark, sf_dir).network_rows))


@query
def res_dom_features(spark, sf_dir):
    return profiles.res_dom_features(judged(lazy_audit(spark, sf_dir).address_rows))


@query
def domain_features(spark, sf_dir):
    pairs = judged(lazy_audit(spark, sf_dir).address_rows)
    return profiles.domain_features(profiles.pair_counters(pairs, profiles.PAIR_FEATURES))


def categorical_counters(spark, sf_dir) -> DataFrame:
    """Per domain, the features that are ranked: their values are few."""
    profile = lazy_audit(spark, sf_dir).pair_profile
    return profiles.domain_features(profiles.pair_counters(profile))


@query
def value_global_freq(spark, sf_dir):
    ordinary, hot = staged_audit(spark, sf_dir).pair_features_by_domain
    of_hot = profiles.with_global_frequency(hot, profiles.domain_features(hot))
    return profiles.with_placed_frequency(ordinary).unionByName(of_hot).select(
        "resolver", "domain", "feature", "value", "n", "global_n"
    )


@query
def value_rank(spark, sf_dir):
    return thresholds.value_rank(categorical_counters(spark, sf_dir))


@query
def value_cum_share(spark, sf_dir):
    shares = thresholds.value_cum_share(categorical_counters(spark, sf_dir))
    for name in ("share", "cum_share", "prev_cum"):
        shares = shares.withColumn(name, F.round(name, 9))
    return shares


@query
def considered_domains(spark, sf_dir):
    return thresholds.considered_domains(lazy_audit(spark, sf_dir).pair_profile)


# Normality and unusual pairs.


def max_ttls(spark, sf_dir) -> DataFrame:
    ranges = thresholds.ttl_ranges(lazy_audit(spark, sf_dir).pair_profile)
    return thresholds.res_dom_max_ttl(ranges)


@query
def res_dom_max_ttl(spark, sf_dir):
    return max_ttls(spark, sf_dir).select("resolver", "domain", "max_ttl")


@query
def ttl_fence(spark, sf_dir):
    return thresholds.ttl_fence(max_ttls(spark, sf_dir))


@query
def ttl_fence_wide(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(
        (F.col("l_orderkey") % 997).alias("resolver"), (F.col("l_partkey") % 20).alias("domain")
    )
    return thresholds.ttl_fence(
        thresholds.res_dom_max_ttl(lines.agg(F.max("l_quantity").alias("max_ttl")))
    )


@query
def freq_cutoff(spark, sf_dir):
    return thresholds.freq_cutoff(categorical_counters(spark, sf_dir))


def wide_cutoff(spark, sf_dir, value: Column) -> DataFrame:
    counters = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("domain"),
        F.lit("wide").alias("feature"),
        value.cast("bigint").alias("value"),
        F.lit(1).alias("n"),
    )
    return thresholds.freq_cutoff(profiles.domain_features(counters))


@query
def freq_cutoff_skewed(spark, sf_dir):
    quantity = F.col("l_quantity")
    return wide_cutoff(spark, sf_dir, F.floor(quantity * quantity * F.col("l_linenumber") / 600))


@query
def freq_cutoff_uniform(spark, sf_dir):
    return wide_cutoff(spark, sf_dir, F.col("l_quantity"))


@query
def ttl_anomalies(spark, sf_dir):
    ranges = staged_audit(spark, sf_dir, ("network_rows",)).ttl_ranges
    fences = thresholds.ttl_fence(thresholds.res_dom_max_ttl(ranges))
    return detection.ttl_anomalies(ranges, fences)


@query
def feature_anomalies(spark, sf_dir):
    counters = staged_audit(spark, sf_dir, ("network_rows",)).pair_counters
    unusual = thresholds.unusual_values(profiles.domain_features(counters))
    return detection.feature_anomalies(counters, unusual)


@query
def anomalies_res_dom(spark, sf_dir):
    found = staged_audit(spark, sf_dir, ("network_rows",)).anomalies_res_dom
    return found.select("resolver", "domain", joined("types").alias("types"))


# Learned thresholds.


@query
def sld_per_asn(spark, sf_dir):
    return detection.sld_per_asn(staged_audit(spark, sf_dir, ("network_slds",)).network_slds)


@query
def count_per_asn_sld(spark, sf_dir):
    return detection.count_per_asn_sld(staged_audit(spark, sf_dir, ("network_slds",)).network_slds)


@query
def params_sld_asn(spark, sf_dir):
    samples = detection.sld_per_asn(staged_audit(spark, sf_dir).network_slds)
    return rounded_summary(thresholds.percentile_summary(samples, "n_sld"))


@query
def params_sld_count(spark, sf_dir):
    samples = detection.count_per_asn_sld(staged_audit(spark, sf_dir).network_slds)
    return rounded_summary(thresholds.percentile_summary(samples, "n"))


def rounded_summary(summary: DataFrame) -> DataFrame:
    return summary.withColumn("value", F.round("value", 6))


@query
def params_json(spark, sf_dir):
    return interchange.params_json(staged_audit(spark, sf_dir).params)


# Profiles per (resolver, network) and confirmed manipulations.


@query
def res_asn_counts(spark, sf_dir):
    return profiles.res_asn_counts(lazy_audit(spark, sf_dir).network_rows)


@query
def res_asn_features(spark, sf_dir):
    audit = lazy_audit(spark, sf_dir)
    return profiles.res_asn_features(audit.network_rows, audit.address_rows)


@query
def res_asn_slds(spark, sf_dir):
    return profiles.res_asn_slds(lazy_audit(spark, sf_dir).network_rows)


@query
def res_asn_servers(spark, sf_dir):
    return profiles.res_asn_servers(lazy_audit(spark, sf_dir).message_addresses)


@query
def fixed_features(spark, sf_dir):
    fixed = profiles.link_profile(lazy_audit(spark, sf_dir).network_rows)
    return fixed.select("resolver", "asn", "n", joined("fixed").alias("fixed"))


@query
def suspicious_res_asn(spark, sf_dir):
    audit = staged_audit(spark, sf_dir)
    return audit.suspicious_res_asn.join(audit.suspicious_servers, profiles.LINK).select(
        "resolver", "asn", "n", "n_sld", joined("fixed").alias("fixed"), "servers"
    )


@query
def anomalies_res_asn(spark, sf_dir):
    return staged_audit(spark, sf_dir).anomalies_res_asn


# Resolvers and the report.


@query
def res_profile(spark, sf_dir):
    profile = profiles.res_profile(staged_audit(spark, sf_dir).resolver_values)
    lists = ("clients", "queries", "servers", "asns")
    return profile.select("resolver", "n", *[joined(name).alias(name) for name in lists])


@query
def resolver_stats(spark, sf_dir):
    return lazy_audit(spark, sf_dir).resolver_stats


@query
def final_report(spark, sf_dir):
    return staged_audit(spark, sf_dir).final_report


# Text interchange.


@query
def export_res_dom(spark, sf_dir):
    return interchange.res_dom_lines(staged_audit(spark, sf_dir).res_dom_table)


@query
def export_res_asn(spark, sf_dir):
    return interchange.res_asn_lines(staged_audit(spark, sf_dir).res_asn_table)


@query
def export_res(spark, sf_dir):
    return interchange.res_lines(staged_audit(spark, sf_dir).res_table)


@query
def import_counters(spark, sf_dir):
    lines = export_res_dom(spark, sf_dir)
    return interchange.table_counters(
        interchange.res_dom_from_lines(lines), ["resolver", "domain"], profiles.PAIR_FEATURES
    )


# Files: written to the shared folder and read back.


def folder(spark) -> str:
    return Staging(spark).folder


def with_odd_names(frame: DataFrame, column: str) -> DataFrame:
    """Empty names, and such with blanks, quotes and separators, by resolver."""
    return frame.withColumn(column, F.expr(ODD_NAME.format(name=column)))


@query
def file_log(spark, sf_dir):
    path = f"{folder(spark)}/log"
    interchange.write_lines(dns_lines(spark, sf_dir).select(F.col("line").alias("value")), path)
    return rows.recursive_success(well_formed(parse_lines(read_log(spark, path))))


@query
def file_asn_view(spark, sf_dir):
    path = f"{folder(spark)}/view"
    lines = spark.sql(VIEW_LINES_SQL, supplier=table(spark, sf_dir, "supplier"))
    interchange.write_lines(lines, path)
    return read_asn_view(spark, path)


@query
def file_anomalies_res_dom(spark, sf_dir):
    path = f"{folder(spark)}/pairs"
    found = with_odd_names(staged_audit(spark, sf_dir).anomalies_res_dom, "domain")
    interchange.write_anomalies_res_dom(found, path)
    return interchange.read_anomalies_res_dom(spark, path).withColumn("types", joined("types"))


@query
def file_anomalies_res_asn(spark, sf_dir):
    path = f"{folder(spark)}/confirmed"
    found = with_odd_names(staged_audit(spark, sf_dir).anomalies_res_asn, "domain")
    interchange.write_anomalies_res_asn(found, path)
    return interchange.read_anomalies_res_asn(spark, path)


@query
def file_report(spark, sf_dir):
    path = f"{folder(spark)}/report"
    interchange.write_report(with_odd_names(staged_audit(spark, sf_dir).final_report, "domains"), path)
    return interchange.read_report(spark, path)
