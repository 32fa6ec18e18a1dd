"""The audit in separate steps that hand results over as files.

``run`` is the whole audit in one application, over a log that is read once. The
other functions do one step each, for runs that keep or exchange the intermediate
files: as text, see ``sources.interchange``, or, with ``tables``, as long Parquet tables
clustered by key, see ``sources.clustered``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resolver_audit.operators import detection, report, thresholds
from resolver_audit.operators.profiles import CATEGORICAL, LINK, PAIR, pair_keys, resolver_stats
from resolver_audit.plans.audit import Audit
from resolver_audit.plans.staging import Staging
from resolver_audit.settings import AuditSettings
from resolver_audit.sources import interchange
from resolver_audit.sources.asn_view import read_asn_view
from resolver_audit.sources.clustered import read_clustered, write_clustered
from resolver_audit.sources.dns_log import parse_lines, read_log

# Names of the files in an output folder.
RES_DOM = "aggregate-res-dom.csv"
RES_DOM_ANOMALIES = "anomalies-res-dom.csv"
PARAMS = "params.json"
RES_ASN = "aggregate-res-asn.csv"
RES_ASN_ANOMALIES = "anomalies-res-asn-dom.csv"
RES = "aggregate-res.csv"
REPORT = "final-report-res.csv"
REJECTED = "rejected-rows.csv"


def audit_of_log(
    spark: SparkSession,
    log: str,
    asn_view: str,
    settings: AuditSettings = AuditSettings(),
    staging: Staging | None = None,
    keep_ttls: bool = False,
) -> Audit:
    """The audit of a text log; ``keep_ttls`` for exported TTL counters."""
    parsed = parse_lines(read_log(spark, log))
    view = read_asn_view(spark, asn_view)
    return Audit(parsed, view, settings, staging, from_text=True, keep_ttls=keep_ttls)


def run(
    spark: SparkSession,
    log: str,
    asn_view: str,
    out: str,
    settings: AuditSettings = AuditSettings(),
    aggregates: bool = False,
) -> DataFrame:
    """Writes every result below ``out`` and returns the report.

    The aggregate files are written on request: nothing later reads them, and
    their lines grow with the number of names of a resolver.
    """
    audit = audit_of_log(spark, log, asn_view, settings, Staging(spark), keep_ttls=aggregates)
    interchange.write_rejected(audit.rejected_rows, f"{out}/{REJECTED}")
    interchange.write_anomalies_res_dom(audit.anomalies_res_dom, f"{out}/{RES_DOM_ANOMALIES}")
    interchange.write_params(audit.params, f"{out}/{PARAMS}")
    interchange.write_anomalies_res_asn(audit.anomalies_res_asn, f"{out}/{RES_ASN_ANOMALIES}")
    interchange.write_report(audit.final_report, f"{out}/{REPORT}")
    if aggregates:
        for lines, name in (
            (interchange.res_dom_lines(audit.res_dom_table), RES_DOM),
            (interchange.res_asn_lines(audit.res_asn_table), RES_ASN),
            (interchange.res_lines(audit.res_table), RES),
        ):
            interchange.write_lines(lines, f"{out}/{name}")
    return audit.final_report


def aggregate_res_dom(
    spark: SparkSession, log: str, asn_view: str, out: str, tables: bool = False
) -> None:
    audit = audit_of_log(spark, log, asn_view, staging=Staging(spark), keep_ttls=True)
    if tables:
        write_clustered(audit.pair_features, out, PAIR)
    else:
        interchange.write_lines(interchange.res_dom_lines(audit.res_dom_table), out)


def find_anomalies_res_dom(
    spark: SparkSession,
    aggregated: str,
    out: str,
    settings: AuditSettings = AuditSettings(),
    tables: bool = False,
) -> None:
    if tables:
        features = read_clustered(spark, aggregated)
        counts = features.filter(F.col("feature") == "clen")
        considered = thresholds.considered_domains(counts, settings.min_resolutions)
        ttls = judged = detection.of_considered(features, considered)
        counters = judged.filter(F.col("feature").isin(*CATEGORICAL))
    else:
        lines = interchange.read_lines(spark, aggregated)
        table = Staging(spark).keep("res_dom", interchange.res_dom_from_lines(lines))
        considered = thresholds.considered_domains(table, settings.min_resolutions)
        judged = detection.of_considered(table, considered)
        counters = interchange.table_counters(judged, pair_keys(judged), CATEGORICAL)
        ttls = interchange.table_counters(judged, pair_keys(judged), ("ttl",))
    found = detection.find_anomalies_res_dom(
        counters, thresholds.ttl_ranges_of_counters(ttls), settings
    )
    interchange.write_anomalies_res_dom(found, out)


def learn_params(
    spark: SparkSession, log: str, asn_view: str, anomalies: str, out: str
) -> None:
    staging = Staging(spark)
    audit = audit_of_log(spark, log, asn_view, staging=staging)
    flagged = interchange.read_anomalies_res_dom(spark, anomalies)
    slds = detection.network_slds(detection.unflagged(audit.network_rows, flagged))
    slds = staging.keep("network_slds", slds)
    interchange.write_params(detection.learn_params(slds), out)


def aggregate_res_asn(
    spark: SparkSession, log: str, asn_view: str, out: str, tables: bool = False
) -> None:
    audit = audit_of_log(spark, log, asn_view, staging=Staging(spark), keep_ttls=True)
    if tables:
        write_clustered(audit.link_features, out, LINK)
    else:
        interchange.write_lines(interchange.res_asn_lines(audit.res_asn_table), out)


def find_anomalies_res_asn(
    spark: SparkSession,
    aggregated: str,
    params: str,
    anomalies: str,
    out: str,
    settings: AuditSettings = AuditSettings(),
    tables: bool = False,
) -> None:
    if tables:
        features = read_clustered(spark, aggregated)
        links = interchange.traits_of(features, settings.fold_case)
        names = interchange.names_of(features, settings.fold_case)
    else:
        lines = interchange.read_lines(spark, aggregated)
        table = Staging(spark).keep("res_asn", interchange.res_asn_from_lines(lines))
        links = interchange.link_traits(table, settings.fold_case)
        names = interchange.names_of_table(table, settings.fold_case)
    suspicious = detection.suspicious_res_asn(
        links, interchange.read_params(spark, params), settings.percentile_pick
    )
    flagged = detection.without_tags(
        interchange.read_anomalies_res_dom(spark, anomalies), settings.ignored_tags
    )
    confirmed = detection.confirmed_pairs(names, suspicious, flagged)
    if tables:
        servers = interchange.servers_of(features, suspicious)
    else:
        servers = interchange.servers_of_table(table, suspicious)
    found = detection.anomalies_res_asn(confirmed, detection.evidence(suspicious, servers))
    interchange.write_anomalies_res_asn(found, out)


def aggregate_res(
    spark: SparkSession, log: str, asn_view: str, out: str, tables: bool = False
) -> None:
    audit = audit_of_log(spark, log, asn_view, staging=Staging(spark))
    if tables:
        write_clustered(audit.resolver_values, out, ["resolver"])
    else:
        interchange.write_lines(interchange.res_lines(audit.res_table), out)


def final_report(
    spark: SparkSession, aggregated: str, anomalies: str, out: str, tables: bool = False
) -> None:
    if tables:
        stats = resolver_stats(read_clustered(spark, aggregated))
    else:
        table = interchange.res_from_lines(interchange.read_lines(spark, aggregated))
        stats = interchange.stats_of_table(table)
    found = interchange.read_anomalies_res_asn(spark, anomalies)
    rows = report.final_report(stats, report.manipulations(found))
    interchange.write_report(rows, out)
