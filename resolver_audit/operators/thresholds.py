"""Normality of a domain: the TTL fence and the frequency cut-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resolver_audit.operators.profiles import pair_keys
from resolver_audit.settings import SUMMARY_POINTS, AuditSettings

# Interpolated quantiles carry rounding noise of about 1e-12; thresholds are
# rounded before anything is compared with them.
DIGITS = 9

DEFAULTS = AuditSettings()


def considered_domains(
    counts: DataFrame, min_resolutions: int = DEFAULTS.min_resolutions
) -> DataFrame:
    """Domains with more than ``min_resolutions`` responses, from rows with ``domain`` and ``n``."""
    return (
        counts.groupBy("domain").agg(F.sum("n").alias("n")).filter(F.col("n") > min_resolutions)
    )


def ttl_ranges(profile: DataFrame) -> DataFrame:
    """Smallest and largest last TTL per (resolver, domain), from a pair profile."""
    return profile.groupBy(*pair_keys(profile)).agg(
        F.min("ttl_min").alias("min_ttl"), F.max("ttl_max").alias("max_ttl")
    )


def ttl_ranges_of_counters(counters: DataFrame) -> DataFrame:
    """The same from TTL counters."""
    ttl = F.col("value").cast("bigint")
    return (
        counters.filter(F.col("feature") == "ttl")
        .groupBy(*pair_keys(counters))
        .agg(F.min(ttl).alias("min_ttl"), F.max(ttl).alias("max_ttl"))
    )


def res_dom_max_ttl(
    ranges: DataFrame, granularity: int = DEFAULTS.ttl_granularity
) -> DataFrame:
    """The largest TTL per (resolver, domain), rounded up to a multiple of ``granularity``."""
    rounded = (F.ceil(F.col("max_ttl") / granularity) * granularity).cast("bigint")
    return ranges.withColumn("max_ttl", rounded)


def ttl_fence(rounded: DataFrame, settings: AuditSettings = DEFAULTS) -> DataFrame:
    """Largest normal TTL per domain, over one ``max_ttl`` per resolver.

    Resolvers with equal values are counted first, so one task never holds more
    than the distinct values of a domain.
    """
    histogram = rounded.groupBy("domain", "max_ttl").agg(F.count(F.lit(1)).alias("resolvers"))
    levels = F.percentile(
        "max_ttl", F.array(F.lit(settings.fence_high), F.lit(settings.fence_low)), F.col("resolvers")
    )
    high, low = F.col("levels")[0], F.col("levels")[1]
    fence = high + settings.fence_reach * (high - low)
    return (
        histogram.groupBy("domain")
        .agg(levels.alias("levels"))
        .select("domain", F.round(fence, DIGITS).alias("fence"))
    )


def _ranked() -> Window:
    return Window.partitionBy("domain", "feature").orderBy(F.desc("n"), "value")


def value_rank(domain_counters: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0, by descending frequency within (domain, feature)."""
    rank = (F.row_number().over(_ranked()) - 1).cast("bigint")
    return domain_counters.withColumn("rank", rank)


def value_cum_share(domain_counters: DataFrame) -> DataFrame:
    """Adds ``share`` and its running sum before and up to each value in rank order."""
    group = Window.partitionBy("domain", "feature")
    so_far = _ranked().rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(group)
    cumulative = F.sum("n").over(so_far)
    return value_rank(domain_counters).select(
        "domain",
        "feature",
        "value",
        "n",
        "rank",
        (F.col("n") / total).alias("share"),
        (cumulative / total).alias("cum_share"),
        ((cumulative - F.col("n")) / total).alias("prev_cum"),
    )


def _weighted_quartile(frequencies: Column, total: Column, p: float) -> Column:
    """Interpolated rank at which the running share of descending frequencies reaches ``p``.

    One pass in rank order, so the running sum is rounded the same way on every
    run: the first value that reaches ``p`` settles the quartile.
    """
    start = F.struct(
        F.lit(0).alias("rank"),
        F.lit(0.0).alias("before"),
        F.lit(None).cast("double").alias("quartile"),
    )

    def step(state: Column, n: Column) -> Column:
        share = n / total
        reached = state["before"] + share
        here = state["rank"] - 1 + (F.lit(p) - state["before"]) / share
        return F.struct(
            (state["rank"] + 1).alias("rank"),
            reached.alias("before"),
            F.coalesce(state["quartile"], F.when(reached >= p, here)).alias("quartile"),
        )

    return F.aggregate(frequencies, start, step, lambda state: state["quartile"])


def _cutoff_groups(domain_counters: DataFrame) -> DataFrame:
    """Per (domain, feature) its values by descending frequency and the cut-off.

    A group holds distinct values only: numbers of records in one message, or
    network labels.
    """
    grouped = (
        domain_counters.groupBy("domain", "feature")
        .agg(
            F.sort_array(F.collect_list(F.struct("n", "value")), asc=False).alias("ranked"),
            F.sum("n").alias("total"),
        )
        .withColumn("frequencies", F.col("ranked.n"))
    )
    frequencies, total = F.col("frequencies"), F.col("total")
    quartiles = grouped.withColumn("q1", _weighted_quartile(frequencies, total, 0.25)).withColumn(
        "q3", _weighted_quartile(frequencies, total, 0.75)
    )
    rank = F.floor(F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    in_range = rank < F.size("frequencies")
    picked = F.when(in_range, F.get("frequencies", rank.cast("int"))).otherwise(0)
    return quartiles.withColumn("cutoff", picked.cast("bigint"))


def freq_cutoff(domain_counters: DataFrame) -> DataFrame:
    """Frequency below which a value is unusual, per (domain, feature).

    Quartiles are taken over ranks weighted by traffic; the cut-off is the
    frequency at rank ``q3 + 1.5 * (q3 - q1)``, rounded down, and 0 beyond the end.
    """
    return _cutoff_groups(domain_counters).select("domain", "feature", "cutoff")


def unusual_values(domain_counters: DataFrame) -> DataFrame:
    """Values that are rarer than the cut-off of their (domain, feature)."""
    groups = _cutoff_groups(domain_counters)
    rare = F.filter("ranked", lambda entry: entry["n"] < F.col("cutoff"))
    return groups.select("domain", "feature", F.explode(rare["value"]).alias("value"))


def percentile_summary(samples: DataFrame, column: str) -> DataFrame:
    """Seven-point percentile summary of ``column``: rows ``pct, value``.

    Equal samples are counted first; the task that interpolates sees distinct
    values only. An empty sample has null percentiles.
    """
    histogram = samples.groupBy(F.col(column).alias("sample")).agg(
        F.count(F.lit(1)).alias("occurrences")
    )
    points = F.array(*[F.lit(p / 100) for p in SUMMARY_POINTS])
    levels = histogram.agg(F.percentile("sample", points, F.col("occurrences")).alias("levels"))
    return levels.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(p).alias("pct"),
                        F.round(F.get("levels", F.lit(i)), DIGITS).alias("value"),
                    )
                    for i, p in enumerate(SUMMARY_POINTS)
                ]
            )
        )
    )

