"""Cut-offs, fences and percentile summaries against numpy."""

import random

import numpy as np
import pytest

from resolver_audit.operators.detection import feature_anomalies, ttl_anomalies
from resolver_audit.operators.profiles import domain_features
from resolver_audit.operators.thresholds import (
    SUMMARY_POINTS,
    freq_cutoff,
    percentile_summary,
    res_dom_max_ttl,
    ttl_fence,
    ttl_ranges_of_counters,
    unusual_values,
)

COUNTER = "resolver string, domain string, feature string, value string, n bigint"


def numpy_cutoff(frequencies):
    ordered = np.sort(np.array(frequencies, dtype=float))[::-1]
    upto = np.cumsum(ordered / ordered.sum())
    before = np.concatenate([[0.0], upto[:-1]])

    def quartile(p):
        i = int(np.argmax(upto >= p))
        return i - 1 + (p - before[i]) / (ordered[i] / ordered.sum())

    q1, q3 = quartile(0.25), quartile(0.75)
    rank = int(np.floor(q3 + 1.5 * (q3 - q1)))
    return int(ordered[rank]) if rank < len(ordered) else 0


def cutoffs(spark, groups):
    rows = [
        (str(g), "asn", str(v), n) for g, values in enumerate(groups) for v, n in enumerate(values)
    ]
    frame = spark.createDataFrame(rows, "domain string, feature string, value string, n bigint")
    found = {int(r.domain): r.cutoff for r in freq_cutoff(frame).collect()}
    return [found[g] for g in range(len(groups))]


def test_cutoff_cases(spark):
    assert cutoffs(spark, [[10], [12, 3], [6, 3], [1, 1, 1, 1]]) == [10, 12, 3, 0]


def test_cutoff_random(spark):
    rng = random.Random(4)
    groups = [
        [rng.choice([1, 2, 3, rng.randrange(1, 1000)]) for _ in range(rng.randrange(1, 40))]
        for _ in range(3000)
    ]
    assert cutoffs(spark, groups) == [numpy_cutoff(g) for g in groups]


def test_fence(spark):
    rng = random.Random(5)
    rows = [(f"r{r}", f"d{d}", "ttl", str(rng.randrange(5000)), 1)
            for d in range(20) for r in range(rng.randrange(1, 60)) for _ in range(3)]
    ranges = ttl_ranges_of_counters(spark.createDataFrame(rows, COUNTER))
    got = {r.domain: r.fence for r in ttl_fence(res_dom_max_ttl(ranges)).collect()}
    for d in {row[1] for row in rows}:
        best = {}
        for resolver, domain, _, ttl, _ in rows:
            if domain == d:
                best[resolver] = max(best.get(resolver, 0), -(-int(ttl) // 5) * 5)
        low, high = np.percentile(list(best.values()), [15, 75])
        assert got[d] == pytest.approx(high + 1.5 * (high - low), abs=1e-8)


def test_percentile_summary(spark):
    rng = random.Random(6)
    samples = [rng.randrange(1, 50) for _ in range(999)]
    frame = spark.createDataFrame([(s,) for s in samples], "x bigint")
    got = {r.pct: r.value for r in percentile_summary(frame, "x").collect()}
    assert got == pytest.approx(dict(zip(SUMMARY_POINTS, np.percentile(samples, SUMMARY_POINTS))))


def test_percentile_summary_of_nothing(spark):
    rows = percentile_summary(spark.createDataFrame([], "x bigint"), "x").collect()
    assert [(r.pct, r.value) for r in rows] == [(p, None) for p in SUMMARY_POINTS]


def test_all_unusual_means_no_usual(spark):
    """The reduced tests against counting usual and unusual observations."""
    rng = random.Random(7)
    rows = []
    for d in range(40):
        for r in range(12):
            for feature, top in (("clen", 4), ("asn", 9), ("ttl", 900)):
                for _ in range(rng.randrange(1, 4)):
                    value = min(int(rng.expovariate(3) * top), top)
                    rows.append((f"r{r}", f"d{d}", feature, str(value), rng.randrange(1, 9)))
    counters = spark.createDataFrame(rows, COUNTER)
    totals = domain_features(counters.filter("feature <> 'ttl'"))
    flagged = feature_anomalies(counters, unusual_values(totals))
    ranges = ttl_ranges_of_counters(counters)
    fences = ttl_fence(res_dom_max_ttl(ranges))
    late = ttl_anomalies(ranges, fences)
    got = {tuple(r) for r in flagged.unionByName(late).collect()}

    frequency = {}
    for _, domain, feature, value, n in rows:
        frequency[domain, feature, value] = frequency.get((domain, feature, value), 0) + n
    cutoff = {
        (d, f): numpy_cutoff([n for (d2, f2, _), n in frequency.items() if (d2, f2) == (d, f)])
        for d, f, _ in frequency
    }
    fence = {r.domain: r.fence for r in fences.collect()}
    usual, unusual = set(), set()
    for resolver, domain, feature, value, _ in rows:
        rare = (
            int(value) > fence[domain]
            if feature == "ttl"
            else frequency[domain, feature, value] < cutoff[domain, feature]
        )
        (unusual if rare else usual).add((resolver, domain, feature))
    assert got == unusual - usual
    assert {f for _, _, f in got} == {"clen", "asn", "ttl"}
