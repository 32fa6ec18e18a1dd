"""The mini-log end to end: in one run, and step by step through the text files."""

import csv
from pathlib import Path

import pytest
from golden import ANOMALIES, CONFIRMED, MIN_RESOLUTIONS, REPORT, VIEW, lines

from resolver_audit.__main__ import main
from resolver_audit.operators import responses, skew
from resolver_audit.plans import steps
from resolver_audit.plans.staging import Staging
from resolver_audit.settings import AuditSettings
from resolver_audit.sources import interchange


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").write_text("\n".join(lines()) + "\n")
    (tmp_path / "view").write_text(VIEW)
    return tmp_path


def read_csv(folder, delimiter=","):
    """Header and rows of a CSV folder, in part order."""
    header, rows = None, []
    for part in sorted(Path(folder).glob("part-*")):
        with open(part, newline="") as file:
            content = list(csv.reader(file, delimiter=delimiter))
        header, rows = content[0], rows + [tuple(row) for row in content[1:]]
    return header, rows


def test_log_has_54_lines():
    assert len(lines()) == 54


def test_one_run(spark, log):
    out = log / "out"
    settings = AuditSettings(min_resolutions=MIN_RESOLUTIONS)
    report = steps.run(spark, str(log / "log"), str(log / "view"), str(out), settings)
    assert report.columns == interchange_report_columns()
    header, rows = read_csv(out / steps.REPORT)
    assert header == interchange_report_columns()
    assert rows == REPORT
    assert read_csv(out / steps.RES_DOM_ANOMALIES)[0] == ["resolver", "query", "type"]
    assert sorted(read_csv(out / steps.RES_DOM_ANOMALIES)[1]) == ANOMALIES
    header, rows = read_csv(out / steps.RES_ASN_ANOMALIES, " ")
    assert header == ["res", "domain", "asn", "servers", "fixed_features"]
    assert sorted(rows) == CONFIRMED
    params = interchange.read_params(spark, str(out / steps.PARAMS))
    assert {r.param: r.value for r in params.filter("pct = 50").collect()} == {
        "sld_asn": 1.0,
        "sld_count": 1.0,
    }


def interchange_report_columns():
    return ["resolver", "queried_domains", "count", "clients", "asn", "domains", "servers"]


@pytest.mark.parametrize(("values", "tables"), [(skew.LINE_VALUES, []), (2, []), (2, ["--tables"])])
def test_step_by_step(spark, log, monkeypatch, values, tables):
    """Every step from the command line, each reading what the last one wrote: lines, short lines, tables."""
    monkeypatch.setattr(skew, "LINE_VALUES", values)
    out = log / "out"
    view = ["--asn-view", str(log / "view")]
    at_least = ["--min-resolutions", str(MIN_RESOLUTIONS)]

    def path(name):
        return str(out / name)

    source = str(log / "log")
    main(["aggregate-res-dom", source, path(steps.RES_DOM), *view, *tables])
    main(["find-anomalies-res-dom", path(steps.RES_DOM), path(steps.RES_DOM_ANOMALIES), *at_least, *tables])
    main(["learn-params", source, path(steps.RES_DOM_ANOMALIES), path(steps.PARAMS), *view])
    main(["aggregate-res-asn", source, path(steps.RES_ASN), *view, *tables])
    main(
        [
            "find-anomalies-res-asn",
            path(steps.RES_ASN),
            path(steps.PARAMS),
            path(steps.RES_DOM_ANOMALIES),
            path(steps.RES_ASN_ANOMALIES),
            *tables,
        ]
    )
    main(["aggregate-res", source, path(steps.RES), *view, *tables])
    main(["final-report", path(steps.RES), path(steps.RES_ASN_ANOMALIES), path(steps.REPORT), *tables])
    assert sorted(read_csv(out / steps.RES_DOM_ANOMALIES)[1]) == ANOMALIES
    assert sorted(read_csv(out / steps.RES_ASN_ANOMALIES, " ")[1]) == CONFIRMED
    assert read_csv(out / steps.REPORT)[1] == REPORT


def test_ignored_tags(spark, log):
    settings = AuditSettings(min_resolutions=MIN_RESOLUTIONS, ignored_tags=("clen",))
    audit = steps.audit_of_log(spark, str(log / "log"), str(log / "view"), settings, Staging(spark))
    assert audit.anomalies_res_dom.count() == 3
    assert audit.anomalies_res_asn.count() == 0


def test_fold_case(spark, log):
    """Names in mixed case are confirmed only when case is folded."""
    text = (log / "log").read_text().splitlines()
    shouted = [t.replace(",a.com,", ",A.com,") if "203.0.113.9" in t else t for t in text]
    (log / "log").write_text("\n".join(shouted) + "\n")

    def confirmed(fold_case):
        settings = AuditSettings(min_resolutions=MIN_RESOLUTIONS, fold_case=fold_case)
        staging = Staging(spark)
        audit = steps.audit_of_log(spark, str(log / "log"), str(log / "view"), settings, staging)
        assert audit.anomalies_res_dom.count() == 3
        return sorted(r.domain for r in audit.anomalies_res_asn.collect())

    assert confirmed(False) == ["b.com", "c.com"]
    assert confirmed(True) == ["a.com", "b.com", "c.com"]


@pytest.mark.parametrize("aggregates", [False, True])
def test_the_log_is_read_once(spark, log, aggregates):
    """After the log has been condensed nothing needs its text, also not the exported counters."""
    source, view = str(log / "log"), str(log / "view")
    broken = ["a,b", lines()[0].replace('"3600,60"', '"x"'), lines()[1].replace('"3600,60"', '"y,60"')]
    (log / "log").write_text("\n".join([*lines(), *broken]) + "\n")
    settings = AuditSettings(min_resolutions=MIN_RESOLUTIONS)
    lazy = steps.audit_of_log(spark, source, view, settings, keep_ttls=aggregates)
    wanted = {r.reason: r.n for r in responses.rejected_rows(lazy.parsed).collect()}
    tables = ("res_dom_table", "res_asn_table", "res_table") if aggregates else ()
    expected = {t: sorted(map(repr, getattr(lazy, t).collect())) for t in (*tables, "final_report")}
    audit = steps.audit_of_log(spark, source, view, settings, Staging(spark), keep_ttls=aggregates)
    kinds = {r.kind: r.n for r in audit.condensed.groupBy("kind").agg({"n": "sum"}).toDF("kind", "n").collect()}
    audited = responses.recursive_success(lazy.parsed).count()
    assert kinds == {"message": audited, "client": audited, "malformed": wanted["field_count"]}
    (log / "log").write_text("")
    assert {r.reason: r.n for r in audit.rejected_rows.collect()} == wanted
    assert wanted["field_count"] >= 1 and wanted["last_ttl"] == 1 and wanted["any_ttl"] == 2
    for name, rows in expected.items():
        assert sorted(map(repr, getattr(audit, name).collect())) == rows
