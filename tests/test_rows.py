"""Row-level rules, on hand-made cases and against small independent rules."""

import random

import pytest
from pyspark.sql import functions as F

from resolver_audit.functions.answers import all_ttls, is_ipv4, last_ttl, ttl_bounds
from resolver_audit.functions.fields import split_fields
from resolver_audit.functions.names import second_level_domain
from resolver_audit.operators.responses import rejected_rows, with_answer_profile
from resolver_audit.sources.dns_log import parse_lines, well_formed

MARK = "\u0001"


def apply(spark, values, *columns):
    """One result row per value, in order."""
    rows = [(i, value) for i, value in enumerate(values)]
    frame = spark.createDataFrame(rows, "i int, v string")
    built = [column(F.col("v")).alias(f"c{k}") for k, column in enumerate(columns)]
    return [tuple(r)[1:] for r in frame.select("i", *built).orderBy("i").collect()]


def test_split_fields_cases(spark):
    cases = {
        'a,"b,c",d': ["a", "b,c", "d"],
        '"a""b",c': ["ab", "c"],
        'a,"b,c': ["a", "b,c"],
        'a"x,y"b': ["ax,yb"],
        "": [""],
        ",": ["", ""],
        f'{MARK}b,"{MARK},{MARK}a"': [f"{MARK}b", f"{MARK},{MARK}a"],
    }
    assert [r[0] for r in apply(spark, cases, split_fields)] == list(cases.values())


def test_split_fields_random(spark):
    rng = random.Random(1)
    lines = ["".join(rng.choices('ab,",' + MARK, k=rng.randrange(20))) for _ in range(3000)]

    def by_quote_parity(line):
        stops = [i for i, c in enumerate(line) if c == "," and line[:i].count('"') % 2 == 0]
        edges = [-1, *stops, len(line)]
        return [line[a + 1 : b].replace('"', "") for a, b in zip(edges, edges[1:])]

    assert [r[0] for r in apply(spark, lines, split_fields)] == [by_quote_parity(x) for x in lines]


@pytest.mark.parametrize("n, kept", [(44, 0), (45, 1), (46, 0), (48, 0), (49, 1), (50, 0)])
def test_layout(spark, n, kept):
    lines = spark.createDataFrame([(",".join(map(str, range(n))),)], "value string")
    rows = well_formed(parse_lines(lines)).collect()
    assert len(rows) == kept
    if n == 45:
        assert tuple(rows[0]) == ("4", "5", "11", "15", "18", "19", "24", "25")
    if n == 49:
        assert tuple(rows[0]) == ("6", "5", "14", "18", "21", "22", "27", "28")


def test_is_ipv4(spark):
    good = ["1.2.3.4", "001.2.3.4", "0.0.0.0", "255.255.255.255", "0000255.1.1.1"]
    bad = ["256.1.1.1", "1.2.3", "1..2.3", " 1.2.3.4", "2001:db8::1", "", "1.2.3.4\n", "1.2.3.4."]
    assert [r[0] for r in apply(spark, good + bad, is_ipv4)] == [True] * 5 + [False] * 8


def test_is_ipv4_random(spark):
    rng = random.Random(2)
    texts = [
        ".".join(str(rng.choice(["", "0", "7", "99", "255", "256", "1000", "a", "007", "-1"]))
                 for _ in range(rng.choice([3, 4, 4, 4, 5])))
        for _ in range(3000)
    ]

    def rule(text):
        parts = text.split(".")
        return len(parts) == 4 and all(p.isdecimal() and int(p) < 256 for p in parts)

    assert [r[0] for r in apply(spark, texts, is_ipv4)] == [rule(t) for t in texts]


def test_answer_profile(spark):
    answers = ["cdn.x|-><-|1.1.1.1|-><-|1.1.1.1", "", "2001:db8::1", "1.1.1.1|-><-|2.2.2.2"]
    frame = with_answer_profile(spark.createDataFrame([(a,) for a in answers], "dans string"))
    rows = frame.select("clen", "nip", "n_servers", "sips").collect()
    assert [tuple(r) for r in rows] == [
        (1, 2, 1, ["1.1.1.1"]),
        (1, 0, 0, []),
        (1, 0, 0, []),
        (0, 2, 2, ["1.1.1.1", "2.2.2.2"]),
    ]


def test_ttls(spark):
    cases = {
        "60,300": (300, [60, 300], 60, 300),
        "x,300": (300, [None, 300], None, None),
        "60,x": (None, [60, None], None, None),
        "": (None, [None], None, None),
        "5.0": (None, [None], None, None),
        "99999999999999999999": (None, [None], None, None),
        "-3": (-3, [-3], -3, -3),
    }
    got = apply(
        spark,
        cases,
        last_ttl,
        all_ttls,
        lambda c: ttl_bounds(c)[0],
        lambda c: ttl_bounds(c)[1],
    )
    assert got == list(cases.values())


def test_second_level_domain(spark):
    cases = {
        "www.google.it": "google.it",
        "www.google.it.": "google.it",
        "google.it..": "it.",
        "a.b.co.uk": "b.co.uk",
        "co.uk": "co.uk",
        "A.B.CO.UK": "CO.UK",
        "x.y.co.in": "y.co.in",
        "com": "com",
        ".": "",
        "": None,
    }
    assert [r[0] for r in apply(spark, cases, second_level_domain)] == list(cases.values())


def line(name="a.com", answers="1.1.1.1", ttls="60", rcode="NOERROR", fields=45):
    cells = ["0"] * fields
    cells[4], cells[5], cells[11], cells[15] = "10.0.0.1", "192.168.0.1", name, rcode
    cells[18] = cells[19] = "1"
    cells[24], cells[25] = answers, f'"{ttls}"'
    return (",".join(cells),)


def test_rejected_rows(spark):
    lines = [line(), line(fields=44), line(fields=46), line(ttls="x"), line(ttls="x,60")]
    lines += [line(name=""), line(ttls="x", answers="cdn"), line(ttls="x", rcode="NXDOMAIN")]
    rejected = rejected_rows(parse_lines(spark.createDataFrame(lines, "value string")))
    assert {r.reason: r.n for r in rejected.collect()} == {
        "field_count": 2,
        "last_ttl": 1,
        "any_ttl": 2,
        "empty_name": 1,
    }


def test_bounds_of_several_ttls(spark):
    from resolver_audit.operators.responses import with_ttls

    texts = ["1", "x", "", None, "3,1,2", "3,x", ",", "5,", "9223372036854775808,1", " 7 "]
    found = with_ttls(spark.createDataFrame([(t,) for t in texts], "danttls string"))
    assert found.columns == ["danttls", "ttl_last", "ttl_min", "ttl_max"]
    for row in found.collect():
        numbers = [int(x) if x.strip().isdigit() and int(x) < 2**63 else None for x in (row.danttls or "").split(",")]
        valid = None not in numbers
        assert row.ttl_last == numbers[-1]
        assert (row.ttl_min, row.ttl_max) == ((min(numbers), max(numbers)) if valid else (None, None))
