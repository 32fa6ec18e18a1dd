"""The log, condensed once for every later stage.

``messages`` merges responses that differ in nothing but their TTLs and clients before
anything expensive happens: the answer is taken apart and its addresses are looked up
once per message. TTLs that count down do not tell messages apart; what later stages
ask of them is kept as a state that merges (how many are valid, the smallest, the
largest). A message that makes up a third of the log leaves each map task as one row.
``observations`` keeps the TTLs apart, for the exported TTL counters only.

Both have ``n`` responses, ``n_last`` of them with an integer last TTL between
``last_min`` and ``last_max``, and ``n_valid`` with integer TTLs only, between
``ttl_min`` and ``ttl_max``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resolver_audit.operators.responses import is_recursive_success, with_answer_profile, with_ttls
from resolver_audit.operators.routing import Routes, with_networks
from resolver_audit.sources.dns_log import LONG_LAYOUT_FIELDS, SHORT_LAYOUT_FIELDS

MESSAGE_KEY = ["resolver", "qname", "dans"]
RESPONSE_KEY = [*MESSAGE_KEY, "danttls"]
TTL_STATE = ["n_last", "last_min", "last_max", "n_valid", "ttl_min", "ttl_max"]


def _state() -> list[Column]:
    """The number of responses and their TTL state, from ``ttl_last, ttl_min, ttl_max``."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.count("ttl_last").alias("n_last"),
        F.min("ttl_last").alias("last_min"),
        F.max("ttl_last").alias("last_max"),
        F.count("ttl_min").alias("n_valid"),
        F.min("ttl_min").alias("ttl_min"),
        F.max("ttl_max").alias("ttl_max"),
    ]


def condensed(parsed: DataFrame, keep_ttls: bool = False) -> DataFrame:
    """Everything that later stages need of the log, from one pass over its parsed lines.

    Rows of ``kind`` message hold a message (in ``resolver, name, dans``) with its number
    and TTL state, rows of kind client a client (``name``) of a resolver, and one row of
    kind malformed the number of lines in neither layout. ``keep_ttls`` keeps messages
    with another list of TTLs (``danttls``) apart, for exported TTL counters. A line that
    is not a successful recursive response gives nothing.
    """
    laid_out = F.col("n_fields").isin(SHORT_LAYOUT_FIELDS, LONG_LAYOUT_FIELDS)
    none, ttls = F.lit(None).cast("string"), ("ttl_last", "ttl_min", "ttl_max")

    def entry(kind: str, resolver, name, dans, danttls, *bounds) -> Column:
        named = dict(resolver=resolver, name=name, dans=dans, danttls=danttls, **dict(zip(ttls, bounds)))
        return F.struct(F.lit(kind).alias("kind"), *[column.alias(c) for c, column in named.items()])

    absent = [F.lit(None).cast("bigint")] * 3
    danttls = F.col("danttls") if keep_ttls else none
    message = entry("message", F.col("resolver"), F.col("qname"), F.col("dans"), danttls, *map(F.col, ttls))
    client = entry("client", F.col("resolver"), F.col("client"), none, none, *absent)
    malformed = entry("malformed", none, none, none, none, *absent)
    entries = F.when(laid_out & is_recursive_success(), F.array(message, client)).when(
        ~laid_out, F.array(malformed)
    )
    keys = ["kind", "resolver", "name", "dans", "danttls"]
    return with_ttls(parsed).select(F.inline(entries)).groupBy(*keys).agg(*_state())


def merged_messages(stored: DataFrame) -> DataFrame:
    """The messages of a condensed log, merged over lists of TTLs that were kept apart."""
    found = stored.filter("kind = 'message'").withColumnRenamed("name", "qname")
    add = [F.sum(c).alias(c) for c in ("n", "n_last", "n_valid")]
    least, most = ("last_min", "ttl_min"), ("last_max", "ttl_max")
    merged = found.groupBy(*MESSAGE_KEY).agg(
        *add, *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most]
    )
    return with_answer_profile(merged)


def messages(responses: DataFrame) -> DataFrame:
    """Distinct (resolver, name, answer) with their number, TTL state and answer profile."""
    return with_answer_profile(with_ttls(responses).groupBy(*MESSAGE_KEY).agg(*_state()))


def merged_responses(responses: DataFrame) -> DataFrame:
    """Distinct responses, lists of TTLs apart, with their number."""
    return responses.groupBy(*RESPONSE_KEY).agg(F.count(F.lit(1)).alias("n"))


def observations(responses: DataFrame) -> DataFrame:
    """As ``messages``, one row for each list of TTLs."""
    return with_state(merged_responses(responses))


def kept_responses(stored: DataFrame) -> DataFrame:
    """Distinct responses from a condensed log that kept lists of TTLs apart."""
    found = stored.filter("kind = 'message'").withColumnRenamed("name", "qname")
    return found.select(*RESPONSE_KEY, "n")


def with_state(merged: DataFrame) -> DataFrame:
    """Adds TTL state and answer profile to distinct responses."""
    n = F.col("n")
    states = {
        "n_last": F.when(F.col("ttl_last").isNotNull(), n).otherwise(0),
        "last_min": F.col("ttl_last"),
        "last_max": F.col("ttl_last"),
        "n_valid": F.when(F.col("ttl_min").isNotNull(), n).otherwise(0),
    }
    return with_answer_profile(with_ttls(merged).withColumns(states).drop("ttl_last"))


def addresses(observed: DataFrame, routes: Routes) -> DataFrame:
    """One row per observation and distinct address, labelled with its network.

    Adds ``domain, ip, asn, asn_raw``, ``lead`` (exactly one row per observation) and
    ``n_ips`` (addresses behind the row). Observations without an address keep
    one row with a null ``ip`` and ``n_ips`` 0.
    """
    kept = [name for name in observed.columns if name != "sips"]
    exploded = observed.select(*kept, F.posexplode_outer("sips").alias("_pos", "ip"))
    marked = (
        exploded.withColumn("lead", F.coalesce(F.col("_pos") == 0, F.lit(True)))
        .withColumn("n_ips", F.col("ip").isNotNull().cast("bigint"))
        .drop("_pos")
    )
    return with_case(with_networks(marked, routes))


def networks(observed: DataFrame, routes: Routes) -> DataFrame:
    """One row per observation and distinct network among its addresses.

    As ``addresses`` with ``n_ips`` for the number of the observation's addresses in that
    network; ``addresses_in`` has the addresses themselves. All that is carried has a fixed
    width, so that the rows are merged by hash where they are.
    """
    per_address = addresses(observed, routes)
    keys = [name for name in RESPONSE_KEY if name in observed.columns]
    carried = ["n", *TTL_STATE, "clen", "nip", "n_servers", "lead"]
    grouped = per_address.groupBy(*keys, "asn", "asn_raw").agg(
        *[F.max(name).alias(name) for name in carried],
        F.sum("n_ips").alias("n_ips"),
    )
    return with_case(grouped)


def addresses_in(rows: DataFrame, routes: Routes) -> DataFrame:
    """Distinct ``resolver, asn, ip``: the addresses behind some ``networks``, from their answers."""
    answers = rows.select("resolver", "asn", "dans").distinct().withColumnRenamed("asn", "_network")
    found = with_answer_profile(answers).select("resolver", "_network", F.explode("sips").alias("ip"))
    labelled = with_networks(found.distinct(), routes).filter(F.col("asn") == F.col("_network"))
    return labelled.select("resolver", "asn", "ip")


def with_case(rows: DataFrame) -> DataFrame:
    """Adds ``domain``, the case-folded name."""
    return rows.withColumn("domain", F.lower("qname"))
