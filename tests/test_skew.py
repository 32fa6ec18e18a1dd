"""Hot keys: a domain that half of the log asks for, and TTLs that count down."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from resolver_audit.operators import detection, observations, profiles, thresholds
from resolver_audit.operators.skew import SALT, SALTS, join_hot
from resolver_audit.plans.audit import Audit
from resolver_audit.plans.staging import Staging
from resolver_audit.settings import AuditSettings
from resolver_audit.sources import interchange
from resolver_audit.sources.asn_view import asn_view
from verification.queries import staged_audit

SF = "/root/testdata/sf0.001"
COLUMNS = "resolver string, client string, qname string, rcode string, rd string, ra string, dans string, danttls string"


def hot_log(size=6000):
    """Half of the responses are for one domain; a few resolvers always answer it with an address of their own."""
    rng = random.Random(3)
    for i in range(size):
        resolver = f"r{rng.randrange(400)}"
        rogue = resolver in ("r7", "r8", "r9")
        if i % 2:
            name = "www.hot.com"
        else:
            name = f"www.d{rng.randrange(40)}.com"
        yield (
            resolver, f"c{i % 50}", name, "NOERROR", "1", "1",
            "9.9.9.9" if rogue else rng.choice(["1.0.0.1", "1.0.0.2", "x|-><-|1.0.0.1"]),
            "86400" if rogue else str(rng.randrange(1, 300)),
        )


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    view = asn_view(spark.createDataFrame([("1.0.0.0", 16, "A")], "network string, prefix_len int, asn string"))
    staging = Staging(spark, str(tmp_path_factory.mktemp("hot")))
    return Audit(spark.createDataFrame(list(hot_log()), COLUMNS), view, AuditSettings(min_resolutions=50), staging)


@pytest.fixture
def without_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_hot_domain_is_spread(hot, without_broadcast):
    profile = hot.considered_profile
    of_hot = profile.filter("domain = 'www.hot.com'")
    parts = [r["count"] for r in of_hot.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == hot.pair_profile.filter("domain = 'www.hot.com'").count() > 400
    assert max(parts) < sum(parts) / 8
    assert profile.select("domain", SALT).distinct().filter("domain = 'www.hot.com'").count() == SALTS


def test_rogue_resolvers_of_a_hot_domain_are_found(hot, without_broadcast):
    found = {(r.resolver, r.domain): r.types for r in hot.anomalies_res_dom.collect()}
    for resolver in ("r7", "r8", "r9"):
        assert "ttl" in found[resolver, "www.hot.com"] and "asn" in found[resolver, "www.hot.com"]
    counters, ranges = hot.pair_counters, hot.ttl_ranges
    plain = Counter((r.resolver, r.domain, r.feature, r.value) for r in counters.drop(SALT).distinct().collect())
    unusual = {(r.domain, r.feature, r.value) for r in thresholds.unusual_values(profiles.domain_features(counters)).collect()}
    usual = {(r, d, f) for r, d, f, v in plain if (d, f, v) not in unusual}
    flagged = {(r, d, f) for r, d, f, _ in plain} - usual
    fences = {r.domain: r.fence for r in thresholds.ttl_fence(thresholds.res_dom_max_ttl(ranges)).collect()}
    flagged |= {(r.resolver, r.domain, "ttl") for r in ranges.collect() if r.min_ttl > fences[r.domain]}
    assert {(*pair, f) for pair, types in found.items() for f in types} == flagged


def test_nothing_is_placed_by_domain_before_it_is_added_up(spark, without_broadcast):
    """Below every exchange by domain (and feature) stands a partial aggregation, or facts with one row per domain."""
    audit = staged_audit(spark, SF)
    found = detection.find_anomalies_res_dom(audit.pair_counters, audit.ttl_ranges, audit.settings)
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    by_domain = [
        i for i, line in enumerate(lines)
        if re.search(r"Exchange hashpartitioning\(domain#\d+(, feature#\d+)?, \d+\)", line)
    ]
    assert by_domain
    assert all("Aggregate" in lines[i + 1] for i in by_domain), [lines[i + 1] for i in by_domain]
    assert any(re.search(r"Exchange hashpartitioning\(domain#\d+, _salt#\d+, \d+\)", line) for line in lines)


def test_join_hot_is_a_join(spark):
    rows = spark.createDataFrame([(f"r{i}", f"d{i % 3}") for i in range(60)], "resolver string, domain string")
    facts = spark.createDataFrame([("d0", 1), ("d1", 2)], "domain string, fact int")
    assert join_hot(rows, facts, ["domain"]).drop(SALT).count() == 40
    left = join_hot(rows, facts, ["domain"], "left").drop(SALT)
    assert left.count() == 60 and left.filter("fact is null").count() == 20


def test_counting_down_adds_no_rows(spark):
    """A message whose TTL counts down is one row; its state holds what the TTLs were."""
    view = asn_view(spark.createDataFrame([("1.0.0.0", 16, "A")], "network string, prefix_len int, asn string"))
    base = ("r", "c", "a.com", "NOERROR", "1", "1", "1.0.0.1")
    rows = [(*base, str(t)) for t in range(300, 0, -1)] + [(*base, "x"), (*base, "5,y"), (*base, "y,5")]
    audit = Audit(spark.createDataFrame(rows, COLUMNS), view)
    (row,) = audit.network_rows.select("n", *observations.TTL_STATE).collect()
    assert tuple(row) == (303, 301, 1, 300, 300, 1, 300)
    (pair,) = audit.pair_profile.collect()
    assert (pair.n, pair.ttl_min, pair.ttl_max) == (301, 1, 300)
    (link,) = profiles.link_profile(audit.network_rows).collect()
    assert (link.n, link.fixed) == (300, ["cname", "nip"])


def test_no_filter_takes_an_answer_apart(spark):
    """Filters on the answer profile stay above the generator that makes it."""
    from verification.queries import REGISTRY

    for name in ("answer_profile", "ip_asn", "rejected_rows"):
        text = REGISTRY[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        filters = [line for line in text.splitlines() if re.match(r"\W*(\*\(\d+\) )?Filter ", line)]
        assert filters and not any("split(" in f and "><" in f for f in filters), name


def test_only_hot_facts_are_copied(spark, monkeypatch):
    """Facts that are as many as the rows stand once; those of a hot key are joined without a shuffle."""
    from resolver_audit.operators import skew

    monkeypatch.setattr(skew, "HOT", 10)
    rows = [(f"r{i}", "hot.com" if i % 2 else f"d{i}.com", "clen", "0", 1) for i in range(100)]
    pairs = spark.createDataFrame(rows, "resolver string, domain string, feature string, value string, n bigint")
    found = profiles.with_global_frequency(pairs, profiles.domain_features(pairs))
    assert sorted((r.resolver, r.domain, r.global_n) for r in found.collect()) == sorted(
        (r, d, 50 if d == "hot.com" else 1) for r, d, *_ in rows
    )
    text = found._jdf.queryExecution().executedPlan().toString()
    assert SALT not in text and "Generate" not in text


def test_counters_of_a_pair_lie_side_by_side(spark):
    """The judged rows are placed by pair; their counters, three times as many, are not shuffled."""
    audit = Audit(spark.createDataFrame(list(hot_log(50)), COLUMNS), asn_view(
        spark.createDataFrame([("1.0.0.0", 16, "A")], "network string, prefix_len int, asn string")))
    pairs = profiles.judged_pairs(audit.address_rows)
    text = profiles.res_dom_features(pairs)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert not any("feature" in e for e in exchanges), exchanges


def test_hot_keys_are_split_off(spark, monkeypatch):
    """Every row is in one of the two parts, also those without a key."""
    from resolver_audit.operators import skew

    monkeypatch.setattr(skew, "HOT", 10)
    rows = [("hot", i) for i in range(1, 8)] + [(f"k{i}", 1) for i in range(30)] + [(None, 2)] * 3
    frame = spark.createDataFrame(rows, "key string, n bigint")
    ordinary, hot = skew.split_hot(frame, F.col("key"))
    assert ordinary.columns == hot.columns == frame.columns
    assert {r.key for r in hot.collect()} == {"hot"}
    assert sorted(map(repr, ordinary.collect() + hot.collect())) == sorted(map(repr, frame.collect()))


def links_audit(spark, tmp_path, *more):
    view = asn_view(spark.createDataFrame([("1.0.0.0", 16, "A")], "network string, prefix_len int, asn string"))
    rows = [(*r[:6], r[6] + "|-><-|7.0.0.1" * (i % 3), r[7] + ",5" * (i % 2)) for i, r in enumerate(hot_log(600))]
    rows += [(None, "c", "n.com", "NOERROR", "1", "1", "1.0.0.1", "7"), *more]
    return Audit(spark.createDataFrame(rows, COLUMNS), view, staging=Staging(spark, str(tmp_path / "kept")))


def test_counters_of_a_network_lie_side_by_side(spark, tmp_path):
    """A row for each response and network is placed; its counters, five times as many, are not shuffled nor stored."""
    audit = links_audit(spark, tmp_path)
    ordinary = audit._link_parts[0]
    text = interchange.res_asn_table(ordinary)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert exchanges and not any("feature" in e for e in exchanges), exchanges
    assert sum(bool(re.match(r"resolver#\d+, asn#\d+", e)) for e in exchanges) == 1
    assert audit.res_asn_table.count() > 400
    assert not (tmp_path / "kept").exists()


@pytest.mark.parametrize("most", [0, 2, 1_000_000])
def test_hot_and_ordinary_resolvers_have_the_same_counters(spark, tmp_path, monkeypatch, most):
    from resolver_audit.operators import skew

    monkeypatch.setattr(skew, "HOT", most)
    audit = links_audit(spark, tmp_path)
    parts = [part.count() for part in audit._link_parts]
    assert [bool(n) for n in parts] == [most > 0, most < 1_000_000]
    whole = interchange.res_asn_table(profiles.res_asn_features(audit.network_rows, audit.address_rows))
    assert sorted(map(repr, audit.res_asn_table.collect())) == sorted(map(repr, whole.collect()))
    fields = ("r1", "c", "d.com", "NOERROR", "1", "1", "1.0.0.1|-><-|8.0.0.1", "7")
    odd = links_audit(spark, tmp_path / "odd", *[(*fields[:i], None, *fields[i + 1 :]) for i in (0, 2, 6, 7)])
    expected = profiles.res_asn_features(odd.network_rows, odd.address_rows)
    assert sorted(map(repr, odd.link_features.collect())) == sorted(map(repr, expected.collect()))


def test_counters_of_an_ordinary_domain_are_added_up_in_place(spark, tmp_path):
    """Rows are placed by domain once; their counters are neither stored nor shuffled to find their frequency."""
    audit = links_audit(spark, tmp_path)
    ordinary, _ = audit.pair_features_by_domain
    text = profiles.with_placed_frequency(ordinary)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert sum(bool(re.match(r"domain#\d+, \d+$", e)) for e in exchanges) == 1
    assert not any("feature" in e for e in exchanges) and "SortMergeJoin" not in text, exchanges
    assert not (tmp_path / "kept").exists()


@pytest.mark.parametrize("most", [0, 20, 1_000_000])
def test_hot_and_ordinary_domains_have_the_same_frequencies(spark, tmp_path, monkeypatch, most):
    """As joined to the sums over all resolvers; names that are missing, or spelled otherwise, as well."""
    from resolver_audit.operators import skew

    fields = ("r1", "c", "WWW.hot.com", "NOERROR", "1", "1", "1.0.0.1|-><-|8.0.0.1", "7")
    more = [fields, *[(*fields[:i], None, *fields[i + 1 :]) for i in (0, 2, 6, 7)]]
    audit = links_audit(spark, tmp_path, *more)
    expected = profiles.with_global_frequency(audit.pair_features, profiles.domain_features(audit.pair_features))
    monkeypatch.setattr(skew, "HOT", most)
    ordinary, hot = audit.pair_features_by_domain
    assert [bool(part.count()) for part in (ordinary, hot)] == [most > 0, most < 1_000_000]
    found = profiles.with_placed_frequency(ordinary).unionByName(
        profiles.with_global_frequency(hot, profiles.domain_features(hot)))
    columns = ["resolver", "domain", "feature", "value", "n", "global_n"]
    assert sorted(map(repr, found.select(columns).collect())) == sorted(map(repr, expected.select(columns).collect()))


def test_a_response_counts_once_per_label(spark, tmp_path):
    """A view may call a network as unrouted addresses are pooled: both are one network then, as the SQL has it."""
    view = asn_view(spark.createDataFrame([("1.0.0.0", 16, "9.9.0.0")], "network string, prefix_len int, asn string"))
    rows = [("r", "c", "a.com", "NOERROR", "1", "1", "1.0.0.1|-><-|9.9.1.1", "7")]
    audit = Audit(spark.createDataFrame(rows, COLUMNS), view, staging=Staging(spark, str(tmp_path)))
    found = {(r.asn, r.feature, r.value): r.n for r in audit.link_features.collect()}
    assert found == {
        ("9.9.0.0", f, v): 1
        for f, v in (("queries", "a.com"), ("clen", "0"), ("nip", "2"), ("ttl", "7"), ("servers", "1.0.0.1"), ("servers", "9.9.1.1"))
    }
