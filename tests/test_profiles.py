"""Profiles of a random log against counting line by line in Python."""

import random
from collections import Counter

import pytest

from resolver_audit.operators import profiles
from resolver_audit.plans.audit import Audit
from resolver_audit.sources.asn_view import asn_view

IPS = ["1.0.0.1", "1.0.0.2", "1.1.0.1", "9.9.9.9", "9.9.8.8", "127.0.0.1", "01.0.0.1"]
LABELS = {"1.0.0.1": "A", "1.0.0.2": "A", "1.1.0.1": "B", "9.9.9.9": "9.9.0.0",
          "9.9.8.8": "9.9.0.0", "127.0.0.1": "127.0.0.1", "01.0.0.1": "01.0.0.1"}
SEPARATOR = "|-><-|"


def random_log(seed, size=1500):
    rng = random.Random(seed)
    for _ in range(size):
        records = rng.choices([*IPS, "cdn.x", "::1", ""], k=rng.randrange(1, 6))
        ttls = rng.choices(["60", "300", "7", "x"], [9, 9, 9, 1], k=rng.randrange(1, 4))
        yield (
            f"r{rng.randrange(4)}",
            f"c{rng.randrange(9)}",
            rng.choice(["a.com", "A.com", "b.co.uk", "x.b.co.uk", "d.net.", ""]),
            rng.choice(["NOERROR"] * 9 + ["NXDOMAIN"]),
            rng.choice("1110"),
            rng.choice("1110"),
            SEPARATOR.join(records),
            ",".join(ttls),
        )


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    log = list(random_log(request.param))
    columns = "resolver client qname rcode rd ra dans danttls".split()
    prefixes = [("1.0.0.0", 16, "A"), ("1.1.0.0", 16, "B"), ("1.0.0.0", 8, "Z")]
    view = asn_view(spark.createDataFrame(prefixes, "network string, prefix_len int, asn string"))
    audit = Audit(spark.createDataFrame(log, ", ".join(f"{c} string" for c in columns)), view)
    judged = [row for row in log if row[3:6] == ("NOERROR", "1", "1")]
    return audit, judged


def parts(row):
    records = row[6].split(SEPARATOR)
    ips = [r for r in records if r in LABELS]
    return records, ips, set(ips)


def counted(frame, *keys):
    return {tuple(r[k] for k in (*keys, "feature", "value")): r.n for r in frame.collect()}


def test_pair_features(case):
    audit, judged = case
    expected = Counter()
    for row in judged:
        resolver, name = row[0], row[2].lower()
        records, ips, distinct = parts(row)
        last = row[7].split(",")[-1]
        if ips and last != "x":
            values = [("ttl", last), ("clen", len(records) - len(ips)), ("nip", len(ips))]
            values += [("sip", ip) for ip in distinct] + [("asn", LABELS[ip]) for ip in distinct]
            expected.update((resolver, name, f, str(v)) for f, v in values)
    pairs = profiles.judged_pairs(audit.address_rows)
    assert counted(profiles.res_dom_features(pairs), "resolver", "domain") == expected
    from_profile = profiles.sum_counters(
        profiles.pair_counters(profiles.pair_profile(profiles.judged_pairs(audit.network_rows))),
        "resolver",
        "domain",
    )
    kept = {k: n for k, n in expected.items() if k[2] in profiles.CATEGORICAL}
    assert counted(from_profile, "resolver", "domain") == kept


def test_link_features(case):
    audit, judged = case
    expected, responses = Counter(), Counter()
    for row in judged:
        records, ips, distinct = parts(row)
        ttls = row[7].split(",")
        if "x" in ttls:
            continue
        for asn in {LABELS[ip] for ip in distinct}:
            key = (row[0], asn)
            responses[key] += 1
            values = [("queries", row[2]), ("clen", len(records) - len(ips)), ("nip", len(distinct))]
            values += [("ttl", t) for t in ttls]
            values += [("servers", ip) for ip in distinct if LABELS[ip] == asn]
            expected.update((*key, f, str(v)) for f, v in values)
    features = profiles.res_asn_features(audit.network_rows, audit.address_rows)
    assert counted(features, "resolver", "asn") == expected
    links = {(r.resolver, r.asn): r for r in profiles.link_profile(audit.network_rows).collect()}
    assert {k: r.n for k, r in links.items()} == responses
    for key, link in links.items():
        distinct = Counter(k[2] for k in expected if k[:2] == key)
        fixed = [n for n, f in (("ttl", "ttl"), ("cname", "clen"), ("nip", "nip")) if distinct[f] == 1]
        assert link.fixed == fixed


def test_resolver_stats(case):
    audit, judged = case
    values = profiles.resolver_values(audit.address_rows, audit.clients)
    for r in profiles.resolver_stats(values).collect():
        own = [row for row in judged if row[0] == r.resolver]
        ips = set().union(*(parts(row)[2] for row in own))
        assert r["count"] == len(own)
        assert r.clients == len({row[1] for row in own})
        assert r.queried_domains == len({row[2] for row in own})
        assert r.returned_servers == len(ips)
        assert r.returned_asns == len({LABELS[ip] for ip in ips})
