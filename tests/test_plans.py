"""Shape of the physical plans, and where intermediate tables go."""

import re

import pytest

from resolver_audit.operators.profiles import LINK
from resolver_audit.operators.routing import Routes, with_networks
from resolver_audit.plans.staging import Staging, staging_root
from resolver_audit.sources import interchange
from resolver_audit.sources.clustered import read_clustered, write_clustered
from verification.queries import lazy_audit, staged_audit
from verification.tables import view

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_the_log_is_merged_once(spark):
    """Lookups take addresses and not responses through the join; TTLs do not tell messages apart."""
    text = plan(lazy_audit(spark, SF).network_rows)
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert any("resolver" in e and "dans" in e for e in exchanges)
    assert not any("danttls" in e for e in exchanges)
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_lookup_is_an_equi_join_on_network_and_length(spark):
    frame = spark.range(10).selectExpr("concat('198.18.0.', id) AS ip")
    text = plan(with_networks(frame, Routes.of(view(spark))))
    assert re.search(r"Join \[network#\d+L?, prefix_len#\d+\]", text)


def test_later_stages_read_only_their_columns(spark):
    text = plan(staged_audit(spark, SF).ttl_ranges)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("qname" not in s and "danttls" not in s for s in schemas)


def test_staging_folder(spark, tmp_path):
    staging = Staging(spark, str(tmp_path / "stage"))
    kept = staging.keep("numbers", spark.range(5))
    assert (tmp_path / "stage" / "numbers").is_dir()
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2, 3, 4]


class FakeSession:
    def __init__(self, **settings):
        self.conf = {key.replace("_", "."): value for key, value in settings.items()}


def test_staging_root():
    shared = FakeSession(spark_checkpoint_dir="hdfs:///c", spark_master="yarn")
    assert staging_root(shared) == "hdfs:///c"
    assert staging_root(FakeSession(spark_master="local[8]")).startswith("/")
    with pytest.raises(ValueError):
        staging_root(FakeSession(spark_master="yarn"))


def test_clustered_tables_are_not_shuffled_by_their_key(spark, tmp_path):
    """Traits, names and servers of links come from a clustered table without an exchange of its rows."""
    schema = "resolver string, asn string, feature string, value string, n bigint"
    rows = [
        (f"r{i % 9}", f"a {i % 4}", f, f"{f},\"{i % 7};", i)
        for i in range(200)
        for f in ("queries", "clen", "ttl", "nip", "servers")
    ]
    features = spark.createDataFrame(rows, schema)
    write_clustered(features, str(tmp_path / "table"), LINK, 4)
    back = read_clustered(spark, str(tmp_path / "table"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = interchange.traits_of(back)
        assert "Exchange" not in plan(links)
        joined = interchange.names_of(back).join(links.filter("n_sld > 0"), LINK).join(
            interchange.servers_of(back, links.filter("n > 0")), LINK
        )
        assert "Exchange" not in plan(joined) and joined.count() > 0
        assert "Exchange" in plan(interchange.traits_of(features))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_networks_are_merged_by_hash(spark):
    """Lists in a group would be sorted; what the rows carry has a fixed width."""
    assert "ObjectHashAggregate" not in plan(lazy_audit(spark, SF).network_rows)


def test_a_table_that_is_read_once_is_not_stored(spark, tmp_path):
    audit = staged_audit(spark, SF, ("network_rows",))
    audit.staging.folder = str(tmp_path)
    found = sorted(map(tuple, audit.pair_profile.collect()), key=repr)
    assert [p.name for p in tmp_path.iterdir()] == ["pair_profile"]
    assert found == sorted(map(tuple, lazy_audit(spark, SF).pair_profile.collect()), key=repr)
