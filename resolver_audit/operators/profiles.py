"""Profiles: counts per (resolver, domain), per domain, per (resolver, network), per resolver.

All counters are long tables ``(keys..., feature, value, n)``. The ``*_counters``
functions only explode; their rows may repeat a key, and every consumer sums or
folds them, so nothing is shuffled before it has to be. Inputs are the rows of
``observations.addresses`` or ``observations.networks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resolver_audit.functions.answers import all_ttls
from resolver_audit.functions.names import second_level_domain
from resolver_audit.operators.observations import RESPONSE_KEY
from resolver_audit.operators.skew import LINE, SALT, in_lines, join_counted

CATEGORICAL = ("clen", "nip", "asn")
PAIR_FEATURES = ("ttl", "clen", "nip", "asn", "sip")
FIXABLE = ("ttl", "cname", "nip")
RESOLVER_FEATURES = ("queries", "servers", "asns")
PAIR = ["resolver", "domain"]
LINK = ["resolver", "asn"]
GLOBAL = ["domain", "feature", "value"]


def pair_keys(rows: DataFrame) -> list[str]:
    """(resolver, domain), and the place of the pair where rows have been dealt."""
    return [*PAIR, SALT] if SALT in rows.columns else PAIR


def _entry(feature: str, value: Column | str, n: Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.struct(
        F.lit(feature).alias("feature"), value.cast("string").alias("value"), n.alias("n")
    )


def judged_pairs(rows: DataFrame) -> DataFrame:
    """Rows that enter the (resolver, domain) profile: an address and an integer last TTL.

    ``n`` counts each such response once, on its leading row; ``n_addresses`` counts
    its distinct addresses.
    """
    judged = rows.filter((F.col("nip") > 0) & (F.col("n_last") > 0))
    return judged.withColumns(
        {
            "n": F.when(F.col("lead"), F.col("n_last")).otherwise(0),
            "n_addresses": F.col("n_last") * F.col("n_ips"),
        }
    )


def pair_profile(pairs: DataFrame) -> DataFrame:
    """Judged pairs merged over TTLs and spellings.

    A (resolver, domain) pair has few combinations of record numbers and
    networks, so this table is far smaller than the one it comes from; all
    detection of unusual pairs runs on it.
    """
    return pairs.groupBy(*PAIR, *CATEGORICAL).agg(
        F.sum("n").alias("n"),
        F.sum("n_addresses").alias("n_addresses"),
        F.min("last_min").alias("ttl_min"),
        F.max("last_max").alias("ttl_max"),
    )


def pair_counters(pairs: DataFrame, features: tuple[str, ...] = CATEGORICAL) -> DataFrame:
    """``resolver, domain, feature, value, n`` of judged pairs or of a pair profile.

    ``ttl``, ``clen`` and ``nip`` count once per response, ``asn`` and ``sip`` once
    per distinct address. ``sip`` needs rows per address, ``ttl`` such of ``observations``.
    """
    per_response = {"ttl": "last_min", "clen": "clen", "nip": "nip"}
    per_address = {"asn": "asn", "sip": "ip"}
    n, n_addresses = F.col("n"), F.col("n_addresses")
    once = [_entry(f, per_response[f], n) for f in features if f in per_response]
    each = [_entry(f, per_address[f], n_addresses) for f in features if f in per_address]
    entries = F.when(n > 0, F.array(*once, *each)).otherwise(F.array(*each))
    return pairs.select(*pair_keys(pairs), F.inline(entries))


def sum_counters(counters: DataFrame, *keys: str) -> DataFrame:
    """Counters added up per ``keys``, feature and value."""
    return counters.groupBy(*keys, "feature", "value").agg(F.sum("n").alias("n"))


def res_dom_counts(pairs: DataFrame) -> DataFrame:
    """Responses per (resolver, domain)."""
    return pairs.groupBy(*PAIR).agg(F.sum("n").alias("n"))


def res_dom_features(
    pairs: DataFrame, features: tuple[str, ...] = PAIR_FEATURES, by: tuple[str, ...] = tuple(PAIR)
) -> DataFrame:
    """Counters per (resolver, domain).

    The judged rows, merged already, are placed by pair: they are a third of their counters,
    and what groups these by pair again finds them side by side. Placed ``by`` domain, what adds
    them up over resolvers does so as well.
    """
    return sum_counters(pair_counters(pairs.repartition(*by), features), *PAIR)


def domain_features(counters: DataFrame) -> DataFrame:
    """Counters per domain across resolvers."""
    return sum_counters(counters, "domain")


def with_global_frequency(pair_features: DataFrame, domain_features: DataFrame) -> DataFrame:
    """Pair counters with ``global_n``, the frequency of the value over all resolvers.

    No fewer than the counters that it adds up, each of which is 1 at least.
    """
    overall = domain_features.withColumnRenamed("n", "global_n")
    return join_counted(pair_features, overall, GLOBAL, "global_n")


def with_placed_frequency(pair_features: DataFrame) -> DataFrame:
    """The same for counters that are placed by domain: they are added up beside each other.

    Joined to their own sums they would be shuffled again, by value. What lacks a domain or a value
    has no frequency here either. All counters of a domain are in one task: for domains that are not hot.
    """
    known = pair_features.filter(F.col("domain").isNotNull() & F.col("value").isNotNull())
    return known.withColumn("global_n", F.sum("n").over(Window.partitionBy(*GLOBAL)))


def judged_links(rows: DataFrame) -> DataFrame:
    """Rows that enter the (resolver, network) profile: an address and integer TTLs only.

    ``n`` counts such responses.
    """
    return rows.filter(F.col("asn").isNotNull() & (F.col("n_valid") > 0)).withColumn("n", F.col("n_valid"))


def res_asn_counts(network_rows: DataFrame) -> DataFrame:
    """Responses per (resolver, network): one per response and distinct network."""
    return judged_links(network_rows).groupBy(*LINK).agg(F.sum("n").alias("n"))


def link_counters(network_rows: DataFrame) -> DataFrame:
    """``resolver, asn, feature, value, n`` of names, CNAMEs and address numbers."""
    n = F.col("n")
    entries = F.array(
        _entry("queries", "qname", n), _entry("clen", "clen", n), _entry("nip", "n_servers", n)
    )
    return judged_links(network_rows).select(*LINK, F.inline(entries))


def ttl_counters(address_rows: DataFrame) -> DataFrame:
    """``resolver, asn, feature, value, n`` of every TTL, from addresses of ``observations``.

    A response counts once per network, however many of its addresses lie in it.
    """
    counted = (
        judged_links(address_rows)
        .groupBy("resolver", "qname", "dans", "danttls", "asn")
        .agg(F.max("n").alias("n"))
        .groupBy(*LINK, "danttls")
        .agg(F.sum("n").alias("n"))
    )
    ttls = F.transform(all_ttls(F.col("danttls")), lambda ttl: _entry("ttl", ttl, F.col("n")))
    return counted.select(*LINK, F.inline(ttls))


def server_counters(address_rows: DataFrame) -> DataFrame:
    """``resolver, asn, feature, value, n`` of the addresses inside each network."""
    return judged_links(address_rows).select(*LINK, F.inline(F.array(_entry("servers", "ip", F.col("n")))))


def res_asn_features(network_rows: DataFrame, address_rows: DataFrame) -> DataFrame:
    """Counters per (resolver, network); ``address_rows`` are those of ``observations``."""
    counters = link_counters(network_rows).unionByName(server_counters(address_rows))
    return sum_counters(counters.unionByName(ttl_counters(address_rows)), *LINK)


def link_rows(address_rows: DataFrame) -> DataFrame:
    """One row per response and network of an address, with the addresses in it.

    Addresses of an observation lie side by side, so that nothing is shuffled. Labels tell networks
    apart here, as they do in the (resolver, network) profile.
    """
    carried = [F.max(name).alias(name) for name in ("n", "clen", "n_servers")]
    grouped = judged_links(address_rows).groupBy(*RESPONSE_KEY, "asn").agg(*carried, F.collect_list("ip").alias("ips"))
    return grouped.select(*LINK, "qname", "danttls", *("n", "clen", "n_servers", "ips"))


def link_features(address_rows: DataFrame, hot: bool = False) -> DataFrame:
    """The counters of ``res_asn_features`` from the addresses of ``observations`` alone.

    Rows are placed by (resolver, network) before they are taken apart into counters, five or more
    of each, so that these are added up and collected where they are. Those of a ``hot`` resolver
    may be too many for that: their counters are added up wherever they come from first.
    """
    n, rows = F.col("n"), link_rows(address_rows)
    once = F.array(_entry("queries", "qname", n), _entry("clen", "clen", n), _entry("nip", "n_servers", n))
    ttls = F.transform(all_ttls(F.col("danttls")), lambda ttl: _entry("ttl", ttl, F.col("n")))
    servers = F.transform("ips", lambda ip: _entry("servers", ip, F.col("n")))
    placed = rows if hot else rows.repartition(*LINK)
    return sum_counters(placed.select(*LINK, F.inline(F.concat(once, ttls, servers))), *LINK)


def _name(fold_case: bool) -> Column:
    return F.col("domain") if fold_case else F.col("qname")


def link_names(network_rows: DataFrame, fold_case: bool = False) -> DataFrame:
    """``resolver, asn, domain``: names per (resolver, network), as asked unless folded."""
    return judged_links(network_rows).select(*LINK, _name(fold_case).alias("domain"))


def res_asn_slds(network_rows: DataFrame, fold_case: bool = False) -> DataFrame:
    """Distinct names and second-level domains per (resolver, network)."""
    return (
        link_names(network_rows, fold_case)
        .distinct()
        .groupBy(*LINK)
        .agg(
            F.count("domain").alias("n_queries"),
            F.countDistinct(second_level_domain(F.col("domain"))).alias("n_sld"),
        )
    )


def link_profile(network_rows: DataFrame, fold_case: bool = False) -> DataFrame:
    """``resolver, asn, n, n_sld, fixed``: what decides whether a (resolver, network) is suspicious.

    ``fixed`` lists the features with one distinct value, in the order ttl, cname,
    nip. One value means minimum equals maximum, which needs no distinct count.
    """
    ranged = (
        judged_links(network_rows)
        .withColumn("sld", second_level_domain(_name(fold_case)))
        .groupBy(*LINK)
        .agg(
            F.sum("n").alias("n"),
            F.countDistinct("sld").alias("n_sld"),
            F.min("ttl_min").alias("ttl_min"),
            F.max("ttl_max").alias("ttl_max"),
            F.min("clen").alias("cname_min"),
            F.max("clen").alias("cname_max"),
            F.min("n_servers").alias("nip_min"),
            F.max("n_servers").alias("nip_max"),
        )
    )
    constant = [
        F.when(F.col(f"{name}_min") == F.col(f"{name}_max"), F.lit(name)) for name in FIXABLE
    ]
    return ranged.select(*LINK, "n", "n_sld", F.array_compact(F.array(*constant)).alias("fixed"))


def address_lists(address_rows: DataFrame) -> DataFrame:
    """The distinct addresses per (resolver, network), sorted and joined by ``:``."""
    return address_rows.groupBy(*LINK).agg(
        F.array_join(F.sort_array(F.collect_set("ip")), ":").alias("servers")
    )


def res_asn_servers(address_rows: DataFrame) -> DataFrame:
    """Address lists of every (resolver, network)."""
    return address_lists(judged_links(address_rows))


def client_pairs(responses: DataFrame) -> DataFrame:
    """Distinct (resolver, client)."""
    return responses.select("resolver", "client").distinct()


def resolver_values(
    rows: DataFrame, clients: DataFrame, features: tuple[str, ...] = RESOLVER_FEATURES
) -> DataFrame:
    """``resolver, feature, value, n``: everything a resolver was seen with.

    ``n`` of feature ``queries`` adds up to the number of responses. ``servers``
    needs rows per address.
    """
    n = F.col("n")
    each = {"servers": "ip", "asns": "asn"}
    tests = {"queries": F.when(F.col("lead"), _entry("queries", "qname", n))} | {
        feature: F.when(F.col("n_ips") > 0, _entry(feature, column, n))
        for feature, column in each.items()
    }
    entries = F.array_compact(F.array(*[tests[f] for f in features if f in tests]))
    seen = rows.select("resolver", F.inline(entries))
    asked = clients.select("resolver", F.inline(F.array(_entry("clients", "client", F.lit(0)))))
    return sum_counters(seen.unionByName(asked), "resolver")


STATISTICS = {
    "clients": "clients",
    "queries": "queried_domains",
    "servers": "returned_servers",
    "asns": "returned_asns",
}


def resolver_stats(values: DataFrame, features: tuple[str, ...] = tuple(STATISTICS)) -> DataFrame:
    """Traffic statistics of every resolver, from ``resolver_values`` of the same features."""
    return values.groupBy("resolver").agg(
        F.sum(F.when(F.col("feature") == "queries", F.col("n"))).alias("count"),
        *[F.count_if(F.col("feature") == f).alias(STATISTICS[f]) for f in features],
    )


def res_profile(values: DataFrame) -> DataFrame:
    """Number of responses and the sorted value lists of every resolver (export form).

    One row each, with all values; the report uses ``resolver_stats``, which needs no lists.
    """
    lists = ("clients", "queries", "servers", "asns")
    listed = F.col("feature").isin(*lists) & F.col("value").isNotNull()

    def members(feature: str) -> Column:
        of_feature = F.filter("_values", lambda entry: entry["feature"] == feature)
        return F.sort_array(F.transform(of_feature, lambda entry: entry["value"])).alias(feature)

    responses = F.sum(F.when(F.col("feature") == "queries", F.col("n")))
    return (
        in_lines(values, ["resolver"])
        .groupBy("resolver", LINE)
        .agg(
            F.coalesce(responses, F.lit(0)).alias("n"),
            F.collect_list(F.when(listed, F.struct("feature", "value"))).alias("_values"),
        )
        .select("resolver", "n", *[members(f) for f in lists])
    )
