"""Text forms: what is written can be read back."""

from resolver_audit.operators import profiles, skew
from resolver_audit.sources import interchange

COUNTERS = "resolver string, domain string, feature string, value string, n bigint"
LINKS = "resolver string, asn string, feature string, value string, n bigint"


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_res_dom_lines(spark):
    content = [
        ("10.0.0.1", "a.com", feature, value, n)
        for feature, value, n in (
            ("clen", "0", 2), ("clen", "1", 3), ("nip", "1", 5), ("asn", "64500", 5),
            ("ttl", "60", 5), ("sip", "1.2.3.4", 5),
        )
    ]
    table = interchange.res_dom_table(spark.createDataFrame(content, COUNTERS))
    lines = interchange.res_dom_lines(table)
    assert [r.value for r in lines.collect()] == [
        'a.com,10.0.0.1,5,"{""0"":2;""1"":3}","{""1"":5}","{""64500"":5}","{""60"":5}","{""1.2.3.4"":5}"'
    ]
    back = interchange.res_dom_from_lines(lines)
    assert back.columns == table.columns
    counters = interchange.table_counters(back, ["resolver", "domain"], profiles.PAIR_FEATURES)
    assert rows(counters) == sorted(content)


def test_res_dom_lines_with_blanks(spark):
    """Other writers put blanks after separators; broken lines are left out."""
    lines = [
        ('a.com,10.0.0.1,5,"{""0"": 2; ""1"": 3}","{}","{}","{""60"": 5}","{}"',),
        ('a,b.com,10.0.0.1,5,"{}","{}","{}","{}","{}"',),
        ('a.com,10.0.0.1,five,"{}","{}","{}","{}","{}"',),
    ]
    table = interchange.res_dom_from_lines(spark.createDataFrame(lines, "value string"))
    assert [(r.domain, r.n, r.clen, r.ttl) for r in table.collect()] == [
        ("a.com", 5, {"0": 2, "1": 3}, {"60": 5})
    ]


def test_res_asn_lines(spark):
    content = [
        ("10.0.0.1", "64500", feature, value, n)
        for feature, value, n in (
            ("queries", "a.com", 2), ("queries", "B.com.", 3), ("clen", "0", 5), ("nip", "1", 5),
            ("ttl", "60", 5), ("ttl", "70", 5), ("servers", "1.2.3.4", 4), ("servers", "1.2.3.3", 5),
        )
    ]
    table = interchange.res_asn_table(spark.createDataFrame(content, LINKS))
    back = interchange.res_asn_from_lines(interchange.res_asn_lines(table))
    assert rows(back.select("resolver", "asn", "n")) == [("10.0.0.1", "64500", 5)]
    link = interchange.links_of_table(back).first()
    assert (link.n, link.n_sld, link.fixed, link.servers) == (
        5, 2, ["cname", "nip"], "1.2.3.3:1.2.3.4",
    )
    assert rows(interchange.names_of_table(back).select("domain")) == [("B.com.",), ("a.com",)]


def test_res_lines(spark):
    content = [("10.0.0.1", 3, ["c"], ["a.com", "b.com"], ["1.2.3.4"], [])]
    schema = "resolver string, n bigint, " + ", ".join(
        f"{c} array<string>" for c in interchange.RES_LISTS
    )
    lines = interchange.res_lines(spark.createDataFrame(content, schema))
    assert lines.first().value == (
        '10.0.0.1,3,"[""c""]","[""a.com"";""b.com""]","[""1.2.3.4""]","[]"'
    )
    stats = interchange.stats_of_table(interchange.res_from_lines(lines)).first()
    assert tuple(stats) == ("10.0.0.1", 3, 1, 2, 1, 0)


def test_anomaly_files(spark, tmp_path):
    pairs = [("10.0.0.1", "a.com", ["ttl", "asn"]), ("10.0.0.2", "b,c.com", ["nip"])]
    frame = spark.createDataFrame(pairs, "resolver string, domain string, types array<string>")
    interchange.write_anomalies_res_dom(frame, str(tmp_path / "pairs"))
    assert rows(interchange.read_anomalies_res_dom(spark, str(tmp_path / "pairs"))) == pairs

    confirmed = [("10.0.0.1", "a.com", "0123", "1.2.3.4:1.2.3.5", "ttl:nip")]
    schema = "resolver string, domain string, asn string, servers string, fixed_features string"
    interchange.write_anomalies_res_asn(spark.createDataFrame(confirmed, schema), str(tmp_path / "c"))
    assert rows(interchange.read_anomalies_res_asn(spark, str(tmp_path / "c"))) == confirmed


def test_params_document(spark):
    content = [(p, pct, v) for p in ("sld_asn", "sld_count") for pct, v in ((0, 1.0), (50, 2.5), (100, 9.0))]
    params = spark.createDataFrame(content, "param string, pct int, value double")
    document = interchange.params_json(params)
    assert document.first().value == (
        '{"SLD_ASN":[[0.0,1.0],[50.0,2.5],[100.0,9.0]],"SLD_COUNT":[[0.0,1.0],[50.0,2.5],[100.0,9.0]]}'
    )
    assert rows(interchange.params_from_json(document)) == content


NAMES = [" a.com", "b.com ", "", 'q"uote', "c,d;e.com", None, "\\N"[:1]]


def test_pair_files_keep_names(spark, tmp_path):
    content = [("r", name, ["x", "y"]) for name in NAMES]
    frame = spark.createDataFrame(content, "resolver string, domain string, types array<string>")
    interchange.write_anomalies_res_dom(frame, str(tmp_path / "pairs"))
    back = interchange.read_anomalies_res_dom(spark, str(tmp_path / "pairs"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, frame.collect()))


def test_confirmed_files_keep_names(spark, tmp_path):
    frame = spark.createDataFrame(
        [("r", name, "64500", "1.2.3.4:1.2.3.5", "") for name in NAMES],
        "resolver string, domain string, asn string, servers string, fixed_features string",
    )
    interchange.write_anomalies_res_asn(frame, str(tmp_path / "pairs"))
    back = interchange.read_anomalies_res_asn(spark, str(tmp_path / "pairs")).select(*frame.columns)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, frame.collect()))


def test_folded_names(spark):
    table = spark.createDataFrame([("r", "1", {"A.com": 1, "a.com": 2})], "resolver string, asn string, queries map<string,bigint>")
    assert sorted(r.domain for r in interchange.names_of_table(table).collect()) == ["A.com", "a.com"]
    assert [r.domain for r in interchange.names_of_table(table, True).collect()] == ["a.com"]


def test_keys_of_many_values_take_several_lines(spark, monkeypatch):
    """Lines hold a bounded number of values; together they hold every value once, and counts add up."""
    content = [("10.0.0.1", "64500", "queries", f"n{i}.com", i + 1) for i in range(500)]
    content += [("10.0.0.1", "64500", f, v, n) for f, v, n in (("clen", "0", 125250), ("nip", "1", 125250), ("ttl", "60", 9))]
    content += [("10.0.0.1", "64500", "servers", f"1.2.3.{i}", 2) for i in range(50)]
    content += [("10.0.0.2", "64500", f, "1", 3) for f in ("queries", "clen", "nip", "ttl", "servers")]
    frame = spark.createDataFrame(content, LINKS)
    whole = interchange.links_of_table(interchange.res_asn_table(frame)).collect()
    monkeypatch.setattr(skew, "LINE_VALUES", 20)
    lines = interchange.res_asn_lines(interchange.res_asn_table(frame)).collect()
    assert len(lines) > 20 and max(r.value.count(";") for r in lines) < 60
    table = interchange.res_asn_from_lines(spark.createDataFrame(lines))
    counters = interchange.table_counters(table, ["resolver", "asn"], interchange.RES_ASN_MAPS)
    assert rows(counters) == sorted(content)
    assert rows(interchange.links_of_table(table)) == sorted(map(tuple, whole))
    assert sum(r.n for r in table.collect()) == 125250 + 3
    values = frame.filter("feature in ('queries', 'servers')").select("resolver", "feature", "value", "n")
    profile = profiles.res_profile(values)
    assert profile.count() > 20
    back = interchange.res_from_lines(interchange.res_lines(profile))
    (one,) = interchange.stats_of_table(back).filter("resolver = '10.0.0.1'").collect()
    assert (one["count"], one.queried_domains, one.returned_servers, one.clients) == (125250, 500, 50, 0)


def test_rows_are_not_shuffled_to_find_their_line(spark, monkeypatch):
    """Keys with many values take several lines; the counters meet only once, by key and line."""
    monkeypatch.setattr(skew, "LINE_VALUES", 10)
    rows = [("r", "big.com", "sip", f"1.0.0.{i}", i) for i in range(95)] + [("r", "a.com", "clen", "0", 3)]
    features = spark.createDataFrame(rows, "resolver string, domain string, feature string, value string, n bigint")
    table = interchange.res_dom_table(features)
    text = table._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "_salt" not in text
    lines = table.collect()
    assert sum(r.domain == "big.com" for r in lines) > 5 and sum(r.domain == "a.com" for r in lines) == 1
    back = interchange.table_counters(interchange.res_dom_from_lines(interchange.res_dom_lines(table)), ["resolver", "domain"], ("sip", "clen"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_a_resolver_has_one_line_however_many_values(spark):
    """The rows of an export do not depend on how many values a key has."""
    names = [f"n{i:05}.com" for i in range(10_050)]
    content = [("10.0.0.1", "queries", name, 2) for name in names] + [("10.0.0.1", "clients", "c", 0), ("10.0.0.2", "queries", "a.com", 1)]
    values = spark.createDataFrame(content, "resolver string, feature string, value string, n bigint")
    found = {r.value.split(",")[0]: r.value for r in interchange.res_lines(profiles.res_profile(values)).collect()}
    listed = ";".join(f'""{name}""' for name in names)
    assert found["10.0.0.1"] == f'10.0.0.1,20100,"[""c""]","[{listed}]","[]","[]"'
    assert profiles.res_profile(values).count() == len(found) == 2


def test_a_network_of_a_resolver_has_one_line_however_many_values(spark):
    """As do the other counter tables: names, addresses and TTLs beyond any bound stay in the line of their key."""
    content = [("10.0.0.1", "64500", "queries", f"n{i}.com", 1) for i in range(10_050)]
    content += [("10.0.0.1", "64500", f, v, n) for f, v, n in (("clen", "0", 10_050), ("nip", "1", 10_050), ("ttl", "60", 9), ("servers", "1.2.3.4", 2))]
    table = interchange.res_asn_table(spark.createDataFrame(content, LINKS))
    (line,) = interchange.res_asn_lines(table).collect()
    assert line.value.startswith('10.0.0.1,64500,10050,"{""n0.com"":1;')
    back = interchange.res_asn_from_lines(interchange.res_asn_lines(table))
    assert rows(interchange.table_counters(back, ["resolver", "asn"], interchange.RES_ASN_MAPS)) == sorted(content)
    pairs = spark.createDataFrame([("r", "a.com", "sip", str(i), 1) for i in range(10_050)] + [("r", "a.com", "clen", "0", 7)], COUNTERS)
    (row,) = interchange.res_dom_table(pairs).collect()
    assert (row.n, len(row.sip), row.clen) == (7, 10_050, {"0": 7})
