"""Longest-prefix match against a scan of the view."""

import ipaddress
import random
import re

import pytest

from resolver_audit.operators.observations import addresses_in
from resolver_audit.operators.routing import Routes, with_networks
from resolver_audit.sources.asn_view import asn_view, read_asn_view


def random_view(rng, size):
    prefixes = {}
    for _ in range(size):
        length = rng.choice([0, 4, 8, 12, 15, 16, 17, 20, 23, 24, 24, 28, 32])
        base = rng.choice([0x0A000000, 0xC6120000, 0xFFFF0000, 0])
        address = (base + rng.randrange(1 << 18)) & 0xFFFFFFFF
        network = ipaddress.ip_network((address, length), strict=False)
        prefixes[network] = str(64000 + len(prefixes))
    return prefixes


def longest_match(prefixes, ip):
    address = ipaddress.ip_address(ip)
    covering = [(n.prefixlen, asn) for n, asn in prefixes.items() if address in n]
    return max(covering)[1] if covering else None


def labels(spark, prefixes, ips):
    rows = [(str(n.network_address), n.prefixlen, asn) for n, asn in prefixes.items()]
    view = asn_view(spark.createDataFrame(rows, "network string, prefix_len int, asn string"))
    routes = Routes.of(view)
    frame = spark.createDataFrame([(ip,) for ip in ips], "ip string")
    return {r.ip: (r.asn, r.asn_raw) for r in with_networks(frame, routes).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_views(spark, seed):
    rng = random.Random(seed)
    prefixes = random_view(rng, 60)
    ips = {"0.0.0.0", "255.255.255.255"}
    for network in prefixes:
        low, high = int(network[0]), int(network[-1])
        near = {low, high, max(low - 1, 0), min(high + 1, 0xFFFFFFFF), rng.randint(low, high)}
        ips |= {str(ipaddress.ip_address(n)) for n in near}
    got = labels(spark, prefixes, sorted(ips))
    for ip in ips:
        asn = longest_match(prefixes, ip)
        pooled = ".".join(ip.split(".")[:2]) + ".0.0"
        label = ip if ip.startswith("127.0.") else asn or pooled
        assert got[ip] == (label, asn or "None"), ip


def test_special_labels(spark):
    prefixes = {ipaddress.ip_network("20.0.0.0/8"): "7", ipaddress.ip_network("127.0.0.0/8"): "8"}
    ips = ["20.3.4.5", "21.3.4.5", "127.0.0.1", "127.1.0.1", "020.3.4.5", None]
    assert labels(spark, prefixes, ips) == {
        "20.3.4.5": ("7", "7"),
        "21.3.4.5": ("21.3.0.0", "None"),
        "127.0.0.1": ("127.0.0.1", "8"),
        "127.1.0.1": ("8", "8"),
        "020.3.4.5": ("020.3.4.5", "020.3.4.5"),
        None: (None, None),
    }


def test_an_empty_view(spark):
    assert labels(spark, {ipaddress.ip_network("1.0.0.0/8"): "1"}, ["9.9.9.9"])["9.9.9.9"][1] == "None"
    view = asn_view(spark.createDataFrame([], "network string, prefix_len int, asn string"))
    frame = spark.createDataFrame([("1.2.3.4",)], "ip string")
    assert [r.asn for r in with_networks(frame, Routes.of(view)).collect()] == ["1.2.0.0"]


def test_many_host_routes_in_one_block(spark):
    rows = spark.range(65536).selectExpr("concat('20.1.', id div 256, '.', id % 256) AS ip", "CAST(id AS string) AS asn")
    view = asn_view(rows.selectExpr("ip AS network", "32 AS prefix_len", "asn"))
    found = with_networks(rows.withColumnRenamed("asn", "expected"), Routes.of(view))
    assert found.filter("asn = expected").count() == 65536


def test_view_file(spark, tmp_path):
    path = tmp_path / "view"
    path.write_text("; a comment\n1.2.3.0/24\t64500\n10.0.0.0/8\t64501\n")
    rows = sorted(tuple(r) for r in read_asn_view(spark, str(path)).collect())
    assert rows == [(0x01020300, 24, "64500"), (0x0A000000, 8, "64501")]


def test_a_small_view_is_looked_up_where_the_rows_are(spark):
    """Rows are not shuffled for their labels, and what they come from is read once."""
    prefixes = [("10.0.0.0", 8, "8"), ("10.1.0.0", 16, "16"), ("10.1.1.0", 24, None), ("10.1.0.0", 16, "16")]
    routes = Routes.of(asn_view(spark.createDataFrame(prefixes, "network string, prefix_len int, asn string")))
    ips = ["10.9.9.9", "10.1.9.9", "10.1.1.9", "11.1.1.1", "10.01.1.1", None]
    frame = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips * 2)], "id int, ip string")
    found = with_networks(frame, routes)
    expected = ["8", "16", "10.1.0.0", "11.1.0.0", "10.01.1.1", None] * 2
    assert [r.asn for r in found.orderBy("id").collect()] == expected
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan ExistingRDD[id#") == 1 and "SortMergeJoin" not in text


def test_both_ways_of_looking_up_agree(spark, monkeypatch):
    from resolver_audit.operators import routing

    rng = random.Random(5)
    prefixes = random_view(rng, 60)
    ips = [str(ipaddress.ip_address(int(n[0]) ^ rng.randrange(4))) for n in prefixes]
    few = labels(spark, prefixes, ips)
    monkeypatch.setattr(routing, "BROADCAST", 0)
    assert labels(spark, prefixes, ips) == few


def test_each_prefix_is_sent_once_under_a_key_of_64_bits(spark):
    prefixes = [("255.0.0.0", 8, "8"), ("10.1.0.0", 16, "16"), ("0.0.0.0", 0, "0")]
    routes = Routes.of(asn_view(spark.createDataFrame(prefixes, "network string, prefix_len int, asn string")))
    ips = ["255.255.255.255", "10.1.2.3", "0.0.0.0", "127.255.255.255", "128.0.0.0", "1.2.3", "1.2.3.4.5", "1..2.3", "", "a.b.c.d"]
    found = with_networks(spark.createDataFrame([(ip,) for ip in ips], "ip string"), routes)
    text = found._jdf.queryExecution().executedPlan().toString()
    expected = {ip: ip for ip in ips[5:]} | dict.fromkeys(ips[2:5], "0") | {ips[0]: "8", ips[1]: "16", "1.2.3.4.5": "0"}
    assert {r.ip: r.asn_raw for r in found.collect()} == expected
    assert len(re.findall(r"HashedRelationBroadcastMode\(List\(\(shiftleft", text)) == 3
    assert {int(n) for n in re.findall(r"prefix_len#\d+ = (\d+)\)", text)} == {0, 8, 16}


def test_addresses_behind_networks_come_from_their_answers(spark):
    prefixes = [("10.0.0.0", 8, "8"), ("10.1.0.0", 16, "16")]
    routes = Routes.of(asn_view(spark.createDataFrame(prefixes, "network string, prefix_len int, asn string")))
    rows = [
        ("r", "8", "10.1.0.1|-><-|10.2.0.1|-><-|10.2.0.2|-><-|10.2.0.1"),
        ("r", "16", "10.1.0.1|-><-|10.2.0.1"),
        ("r", "8", "c.net|-><-|10.3.0.1"),
        ("s", "9.9.0.0", "9.9.9.9|-><-|10.1.0.9"),
        ("s", "8", ""),
    ]
    found = addresses_in(spark.createDataFrame(rows * 2, "resolver string, asn string, dans string"), routes)
    expected = [("r", "16", "10.1.0.1"), *[("r", "8", ip) for ip in ("10.2.0.1", "10.2.0.2", "10.3.0.1")]]
    assert sorted(map(tuple, found.collect())) == [*expected, ("s", "9.9.0.0", "9.9.9.9")]
