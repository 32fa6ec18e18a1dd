import itertools
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from resolver_audit.llm.queries import REGISTRY
from resolver_audit.llm.resharding import Resharding, min_cost_flow, write_shards



def old_shards():
    return F.pmod(F.xxhash64(F.lit("old"), "text"), F.lit(12))


def least_moved(supply, capacity):
    return sum(max(0, s - (capacity[i] if i < len(capacity) else 0)) for i, s in enumerate(supply))


@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_flow_moves_the_fewest_bytes(supply, n):
    total = sum(supply)
    capacity = [total * (j + 1) // n - total * j // n for j in range(n)]
    flows = min_cost_flow(supply, capacity, lambda i, j: int(i != j))
    assert [sum(f for (i, _), f in flows.items() if i == k) for k in range(len(supply))] == supply
    assert [sum(f for (_, j), f in flows.items() if j == k) for k in range(n)] == capacity
    assert sum(f for (i, j), f in flows.items() if i != j) == least_moved(supply, capacity)


def test_flow_with_other_costs():
    price = {(0, 0): 4, (0, 1): 1, (1, 0): 2, (1, 1): 3}
    best = min(
        sum(price[k] * v for k, v in zip(itertools.product((0, 1), (0, 1)), (a, 5 - a, 4 - a, a - 1 + 0), strict=True))
        for a in range(1, 5)
    )
    flows = min_cost_flow([5, 3], [4, 4], lambda i, j: price[i, j])
    assert sum(price[k] * v for k, v in flows.items()) == best


def check(frame, plan, shards, spread):
    rows = plan.collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in frame.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
    assert max(sizes.values()) - min(sizes[j] for j in range(shards)) <= spread
    return rows


def test_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = check(documents, Resharding().plan(documents, old_shards()), 16, 12_000)
    old = Counter()
    for r in rows:
        old[r.old] += r["size"]
    total = sum(old.values())
    capacity = Resharding().capacities(total)
    moved = sum(r["size"] for r in rows if r.old != r.shard)
    assert moved <= least_moved([old[i] for i in range(12)], capacity) + 0.02 * total


def test_a_large_group_is_split(spark):
    texts = ["the same text again"] * 700 + [f"text number {i} of its own" for i in range(1300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(frame, Resharding(shards=4).plan(frame, old_shards()), 4, 600)


def test_odd_texts(odd, nothing):
    check(odd, Resharding(shards=2).plan(odd, old_shards()), 2, 1 << 20)
    assert Resharding().plan(nothing, old_shards()).count() == 0


@pytest.mark.parametrize("n_old", [3, 8])
def test_rewrite_touches_only_what_changes(spark, documents, tmp_path, n_old):
    texts = documents.select("doc_id", "text", "lang")
    texts = texts.union(texts.limit(3))
    old = F.pmod(F.xxhash64("text"), F.lit(n_old))
    texts.withColumn("shard", old).write.partitionBy("shard").parquet(str(tmp_path / "old"))
    plan = Resharding(shards=5).plan(texts, old)
    changed = Resharding(shards=5).rewrite(str(tmp_path / "old"), plan, str(tmp_path / "new"))
    written = spark.read.parquet(str(tmp_path / "new")).collect()
    wanted = Counter((r.doc_id, r.shard) for r in plan.collect() if r.shard in changed)
    assert Counter((r.doc_id, r.shard) for r in written) == wanted
    assert all(r.old == r.shard for r in plan.collect() if r.shard not in changed)


def test_null_and_empty_texts_stay_together(spark):
    """Both have one byte and no text, so they are equal texts: no edge of a flow parts them."""
    rows = [(i, f"text {i} " * 40) for i in range(400)] + [(1000 + i, None if i % 2 else "") for i in range(20)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    old = F.pmod(F.xxhash64(F.lit("old"), F.coalesce("text", F.lit(""))), F.lit(3))
    plan = Resharding(shards=4).plan(documents, old).filter("doc_id >= 1000")
    assert {(r.size, r.text_crc32) for r in plan.collect()} == {(1, 0)}
    assert plan.select("shard").distinct().count() == 1


def resharded(documents, tmp_path, shards, name="shard", n_old=3):
    old = F.pmod(F.xxhash64(F.lit("old"), F.coalesce("text", F.lit(""))), F.lit(n_old))
    given = write_shards(documents, old, name, str(tmp_path / "old"))
    rows = Resharding(shards=shards).reshard(given, name, str(tmp_path / "new"))
    return rows.withColumn("old", old)


def tidy(documents, rows, name="shard"):
    """All rows are there as they were, and slots are gapless; bytes and texts by shard."""
    columns = documents.columns
    assert Counter(tuple(r[c] for c in columns) for r in rows) == Counter(map(tuple, documents.collect()))
    slots, sizes, texts = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        slots[r[name]].append(r.slot)
        sizes[r[name]] += len((r.text or "").encode()) + 1
        texts[r.text or ""].add(r[name])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return sizes, texts


def test_reshard_reads_back_what_it_wrote(spark, tmp_path):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = resharded(documents, tmp_path, 16, n_old=12).collect()
    sizes, texts = tidy(documents, rows)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 12_000
    assert all(len(v) == 1 for v in texts.values())
    old = Counter()
    for r in rows:
        old[r.old] += len((r.text or "").encode()) + 1
    moved = sum(len((r.text or "").encode()) + 1 for r in rows if r.old != r.shard)
    total = sum(old.values())
    assert moved <= least_moved([old[i] for i in range(12)], Resharding().capacities(total)) + 0.02 * total


def test_only_shards_that_change_are_written(spark, tmp_path):
    """Two old shards are as large as they shall be and stay as they are; the third and fourth even out."""
    sized = spark.createDataFrame(
        [(i, f"text {i:04d} " + "w " * 50, i % 2) for i in range(250)]
        + [(1000 + i, f"text {i:04d} " + "v " * 50, 2 if i < 200 else 3) for i in range(250)],
        "doc_id long, text string, at int",
    )
    given = write_shards(sized, F.col("at"), "shard", str(tmp_path / "old"))
    out = Resharding(shards=4).reshard(given, "shard", str(tmp_path / "new")).collect()
    assert {p.name for p in (tmp_path / "new").glob("shard=*")} == {"shard=2", "shard=3"}
    sizes, _ = tidy(sized, out)
    assert max(sizes.values()) - min(sizes.values()) <= 300
    assert all(r.shard == r["at"] for r in out if r["at"] < 2)


def test_a_text_that_fits_a_shard_stays_whole(spark, tmp_path):
    texts = ["the same text again"] * 200 + [f"text number {i} of its own" for i in range(1300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, places = tidy(frame, resharded(frame, tmp_path, 4).collect())
    assert all(len(v) == 1 for v in places.values())
    assert max(sizes.values()) - min(sizes.values()) <= 600


@pytest.mark.parametrize("repeated", [False, True])
def test_a_text_too_large_for_a_shard_is_cut(spark, tmp_path, repeated):
    """Also if all its rows are the same row."""
    hot = [(7 if repeated else i, "the same text again") for i in range(700)]
    frame = spark.createDataFrame(
        hot + [(1000 + i, f"text number {i} of its own") for i in range(1300)], "doc_id long, text string"
    )
    sizes, places = tidy(frame, resharded(frame, tmp_path, 4).collect())
    assert {t for t, v in places.items() if len(v) > 1} == {"the same text again"}
    assert max(sizes.values()) - min(sizes.values()) <= 600


def test_reshard_odd_texts_and_names(spark, odd, nothing, tmp_path):
    frame = odd.withColumnsRenamed({"score": "h", "key": "row", "cls": "edge", "lang": "slot", "source": "shard"})
    given = write_shards(frame, F.pmod(F.xxhash64("text"), F.lit(3)), "part", str(tmp_path / "old"))
    out = Resharding(shards=2).reshard(given, "part", str(tmp_path / "new"), "place")
    rows = out.collect()
    assert Counter(tuple(r[c] for c in frame.columns) for r in rows) == Counter(map(tuple, frame.collect()))
    for part in {r.part for r in rows}:
        assert sorted(r.place for r in rows if r.part == part) == list(range(sum(r.part == part for r in rows)))
    assert resharded(nothing, tmp_path / "none", 2).count() == 0


def test_query_on_taken_names(spark, odd, tmp_path):
    odd.withColumnsRenamed({"key": "shard", "cls": "Slot"}).write.parquet(str(tmp_path / "documents.parquet"))
    rows = REGISTRY["op9_min_cost_resharding"](spark, str(tmp_path)).collect()
    assert len(rows) == odd.count() and {r.shard for r in rows} <= set(range(16))
