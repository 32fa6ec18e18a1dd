"""Text interchange of intermediate and final results.

Counters are written as JSON inside one comma separated line: a double quote
becomes two, a comma becomes a semicolon, and the document is put in quotes. The
form loses names with commas or semicolons; Parquet tables of the same columns do
not. Lines with an unexpected shape are left out on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resolver_audit.functions.names import second_level_domain
from resolver_audit.operators.profiles import LINK, PAIR, address_lists
from resolver_audit.operators.report import REPORT_COLUMNS
from resolver_audit.operators.skew import LINE, in_lines

# Column order of the exported lines and of the report files.
RES_DOM_MAPS = ("clen", "nip", "asn", "ttl", "sip")
RES_ASN_MAPS = ("queries", "clen", "ttl", "nip", "servers")
RES_LISTS = ("clients", "queries", "servers", "asns")
RES_DOM_ANOMALY_COLUMNS = ("resolver", "query", "type")
RES_ASN_ANOMALY_COLUMNS = ("res", "domain", "asn", "servers", "fixed_features")

# Names keep blanks at their ends; an empty name is not a missing one.
EXACT = {
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "emptyValue": '""',
    "nullValue": "\\N",
    "escape": '"',
}

COUNTER = "map<string,bigint>"
LIST = "array<string>"


# Counter tables: one map per feature, one row per key, however many values it has. Tables of short
# lines, which other writers may make, have several rows of a key, which add up and share no value.


def _counter(feature: str) -> Column:
    of_feature = F.filter("_values", lambda entry: entry["feature"] == feature)
    entries = F.transform(of_feature, lambda entry: F.struct(entry["value"].alias("value"), entry["n"].alias("n")))
    return F.map_from_entries(F.sort_array(entries)).alias(feature)


def _table(features: DataFrame, keys: list[str], maps: tuple[str, ...]) -> DataFrame:
    """All values of a key, which has one line unless short ones are asked for, are collected once, then told apart by feature."""
    responses = F.sum(F.when(F.col("feature") == "clen", F.col("n")))
    values = F.collect_list(F.when(F.col("feature").isin(*maps), F.struct("feature", "value", "n")))
    return (
        in_lines(features, keys)
        .groupBy(*keys, LINE)
        .agg(F.coalesce(responses, F.lit(0)).alias("_n"), values.alias("_values"))
        .select(*keys, F.col("_n").alias("n"), *[_counter(f) for f in maps])
    )


def res_dom_table(features: DataFrame) -> DataFrame:
    """``domain, resolver, n`` and the counters of (resolver, domain) as maps."""
    return _table(features, PAIR, RES_DOM_MAPS).select("domain", "resolver", "n", *RES_DOM_MAPS)


def res_asn_table(features: DataFrame) -> DataFrame:
    """``resolver, asn, n`` and the counters of (resolver, network) as maps."""
    return _table(features, LINK, RES_ASN_MAPS).select(*LINK, "n", *RES_ASN_MAPS)


def table_counters(table: DataFrame, keys: list[str], features: tuple[str, ...]) -> DataFrame:
    """A counter table back as ``keys, feature, value, n``."""
    def entries(feature: str) -> Column:
        return F.transform(
            F.map_entries(feature),
            lambda entry: F.struct(
                F.lit(feature).alias("feature"),
                entry["key"].alias("value"),
                entry["value"].alias("n"),
            ),
        )

    return table.select(*keys, F.inline(F.concat(*[entries(f) for f in features])))


def _folded(names: Column, fold_case: bool) -> Column:
    return F.array_distinct(F.transform(names, F.lower)) if fold_case else names


def links_of_table(table: DataFrame, fold_case: bool = False) -> DataFrame:
    """A (resolver, network) table as ``resolver, asn, n, n_sld, fixed, servers``."""
    return link_traits(table, fold_case).join(servers_of_table(table), LINK)


def link_traits(table: DataFrame, fold_case: bool = False) -> DataFrame:
    """The same without the address lists."""
    return traits_of(table_counters(table, LINK, ("clen", "nip", "ttl", "queries")), fold_case)


def traits_of(features: DataFrame, fold_case: bool = False) -> DataFrame:
    """The same from long counters per (resolver, network)."""
    counters = features.filter(F.col("feature").isin("clen", "nip", "ttl", "queries"))
    is_name, value = F.col("feature") == "queries", F.col("value")
    name = second_level_domain(F.lower(value) if fold_case else value)
    merged = (
        counters.withColumn("value", F.when(is_name, name).otherwise(value))
        .groupBy(*LINK, "feature", "value")
        .agg(F.sum("n").alias("n"))
    )

    def distinct(feature: str) -> Column:
        return F.count_if((F.col("feature") == feature) & F.col("value").isNotNull())

    counted = {"ttl": "ttl", "cname": "clen", "nip": "nip"}
    constant = [F.when(distinct(feature) == 1, F.lit(name)) for name, feature in counted.items()]
    return merged.groupBy(*LINK).agg(
        F.sum(F.when(F.col("feature") == "clen", F.col("n"))).alias("n"),
        distinct("queries").alias("n_sld"),
        F.array_compact(F.array(*constant)).alias("fixed"),
    )


def names_of(features: DataFrame, fold_case: bool = False) -> DataFrame:
    """The names in long counters per (resolver, network): ``resolver, asn, domain``."""
    name = F.lower("value") if fold_case else F.col("value")
    return features.filter(F.col("feature") == "queries").select(*LINK, name.alias("domain"))


def servers_of(features: DataFrame, links: DataFrame) -> DataFrame:
    """The address lists of ``links``, from long counters per (resolver, network)."""
    rows = features.filter(F.col("feature") == "servers").join(links.select(*LINK), LINK, "left_semi")
    return address_lists(rows.select(*LINK, F.col("value").alias("ip")))


def servers_of_table(table: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """The address lists of ``links``, or of all, from a (resolver, network) table."""
    wanted = table.join(links.select(*LINK), LINK, "left_semi") if links is not None else table
    return address_lists(wanted.select(*LINK, F.explode(F.map_keys("servers")).alias("ip")))


def names_of_table(table: DataFrame, fold_case: bool = False) -> DataFrame:
    """The names of a (resolver, network) table: ``resolver, asn, domain``."""
    return table.select(*LINK, F.explode(_folded(F.map_keys("queries"), fold_case)).alias("domain"))


def stats_of_table(table: DataFrame) -> DataFrame:
    """A resolver table as the statistics of ``profiles.resolver_stats``."""
    sizes = {
        "clients": "clients",
        "queried_domains": "queries",
        "returned_servers": "servers",
        "returned_asns": "asns",
    }

    def entries(feature: str) -> Column:
        name = F.lit(feature).alias("feature")
        return F.transform(feature, lambda value: F.struct(name, value.alias("value")))

    lists = F.concat(*[entries(feature) for feature in sizes.values()])
    seen = table.select("resolver", F.inline(lists)).distinct()
    counted = seen.groupBy("resolver").agg(
        *[F.count_if(F.col("feature") == c).alias(name) for name, c in sizes.items()]
    )
    totals = table.groupBy("resolver").agg(F.sum("n").alias("count"))
    return totals.join(counted, "resolver", "left").na.fill(0, list(sizes))


# Lines.


def _escaped(document: Column) -> Column:
    text = F.replace(F.replace(document, F.lit('"'), F.lit('""')), F.lit(","), F.lit(";"))
    return F.concat(F.lit('"'), text, F.lit('"'))


def _unescaped(field: Column) -> Column:
    text = F.replace(F.replace(field, F.lit('""'), F.lit('"')), F.lit(";"), F.lit(","))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _lines(table: DataFrame, plain: list[str], documents: tuple[str, ...]) -> DataFrame:
    fields = [F.col(c).cast("string") for c in plain]
    fields += [_escaped(F.to_json(c)) for c in documents]
    return table.select(F.concat_ws(",", *fields).alias("value"))


def _from_lines(
    lines: DataFrame, plain: list[str], documents: tuple[str, ...], kind: str
) -> DataFrame:
    """Fields and documents are generated, so that a line is taken apart and parsed once."""
    split = lines.select(F.explode(F.array(F.split("value", ",", -1))).alias("_fields"))
    names = [*plain, *documents]

    def field(i: int, name: str) -> Column:
        text = F.get("_fields", F.lit(i))
        if name == "n":
            return text.try_cast("bigint").alias(name)
        return (F.from_json(_unescaped(text), kind) if name in documents else text).alias(name)

    parsed = F.struct(*[field(i, name) for i, name in enumerate(names)])
    return (
        split.filter(F.size("_fields") == len(names))
        .select(F.inline(F.array(parsed)))
        .dropna(subset=["n", *documents])
    )


def res_dom_lines(table: DataFrame) -> DataFrame:
    return _lines(table, ["domain", "resolver", "n"], RES_DOM_MAPS)


def res_asn_lines(table: DataFrame) -> DataFrame:
    return _lines(table, [*LINK, "n"], RES_ASN_MAPS)


def res_lines(table: DataFrame) -> DataFrame:
    """From ``profiles.res_profile``."""
    return _lines(table, ["resolver", "n"], RES_LISTS)


def res_dom_from_lines(lines: DataFrame) -> DataFrame:
    return _from_lines(lines, ["domain", "resolver", "n"], RES_DOM_MAPS, COUNTER)


def res_asn_from_lines(lines: DataFrame) -> DataFrame:
    return _from_lines(lines, [*LINK, "n"], RES_ASN_MAPS, COUNTER)


def res_from_lines(lines: DataFrame) -> DataFrame:
    return _from_lines(lines, ["resolver", "n"], RES_LISTS, LIST)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


# Flagged pairs, thresholds, confirmed pairs, report.


def write_anomalies_res_dom(anomalies: DataFrame, path: str) -> None:
    """CSV with header; the type list is joined by ``:``."""
    columns = ["resolver", "domain", F.array_join("types", ":")]
    named = anomalies.select(
        *[
            (F.col(c) if isinstance(c, str) else c).alias(name)
            for c, name in zip(columns, RES_DOM_ANOMALY_COLUMNS)
        ]
    )
    named.write.mode("overwrite").csv(path, header=True, **EXACT)


def read_anomalies_res_dom(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in RES_DOM_ANOMALY_COLUMNS)
    rows = spark.read.csv(path, header=True, schema=schema, **EXACT | {"emptyValue": ""})
    return rows.select(
        "resolver", F.col("query").alias("domain"), F.split("type", ":").alias("types")
    )


def params_json(params: DataFrame) -> DataFrame:
    """The learned summaries as one JSON document, each a list of [percentile, value]."""
    def summary(param: str) -> Column:
        point = F.array(F.col("pct").cast("double"), F.col("value"))
        points = F.collect_list(F.when(F.col("param") == param, point))
        return F.sort_array(points).alias(param.upper())

    return params.agg(summary("sld_asn"), summary("sld_count")).select(
        F.to_json(F.struct("SLD_ASN", "SLD_COUNT")).alias("value")
    )


def params_from_json(document: DataFrame) -> DataFrame:
    """The document back as rows ``param, pct, value``."""
    schema = "SLD_ASN array<array<double>>, SLD_COUNT array<array<double>>"
    parsed = document.select(F.from_json("value", schema).alias("p"))

    def points(param: str) -> DataFrame:
        return parsed.select(F.explode(f"p.{param.upper()}").alias("point")).select(
            F.lit(param).alias("param"),
            F.col("point")[0].cast("int").alias("pct"),
            F.col("point")[1].alias("value"),
        )

    return points("sld_asn").unionByName(points("sld_count"))


def write_params(params: DataFrame, path: str) -> None:
    """One JSON document: a single row of two times seven points."""
    params_json(params).write.mode("overwrite").text(path)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    return params_from_json(spark.read.text(path))


def write_anomalies_res_asn(anomalies: DataFrame, path: str) -> None:
    """Space separated with header."""
    columns = ("resolver", "domain", "asn", "servers", "fixed_features")
    named = anomalies.select(
        *[F.col(c).alias(name) for c, name in zip(columns, RES_ASN_ANOMALY_COLUMNS)]
    )
    named.write.mode("overwrite").csv(path, sep=" ", header=True, **EXACT)


def read_anomalies_res_asn(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in RES_ASN_ANOMALY_COLUMNS)
    rows = spark.read.csv(path, sep=" ", header=True, schema=schema, **EXACT | {"emptyValue": ""})
    return rows.withColumnRenamed("res", "resolver")


def write_rejected(rejected: DataFrame, path: str) -> None:
    """CSV with header: reason, n."""
    rejected.select("reason", "n").write.mode("overwrite").csv(path, header=True)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The report as it was written, every cell as text."""
    schema = ", ".join(f"`{c}` string" for c in REPORT_COLUMNS)
    return spark.read.csv(path, header=True, schema=schema, **EXACT | {"emptyValue": ""})


def write_report(report: DataFrame, path: str) -> None:
    """CSV with header. The part files follow the order of the report."""
    report.write.mode("overwrite").csv(path, header=True, **EXACT)
