"""The registered queries keep their columns, and the pipeline does what its stages do one by one."""

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from resolver_audit.llm.oracle import ORACLES
from resolver_audit.llm.queries import REGISTRY
from resolver_audit.llm.storage import stored
from verification.check import compare, connect

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op2_sentencepiece_lattice": "doc_id n_tokens ids_crc32 n_bytes text_crc32",
    "op3_toxicity": "doc_id held_out score predicted",
    "op4_signature_join": "doc_id n_shingles component_id",
    "op5_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op6_decontamination": "doc_id item_id first_word similarity",
    "op7_rans_tokens": "doc_id start n_tokens ids_crc32",
    "op8_vp_search": "query_id rank vec_id score",
    "op9_min_cost_resharding": "doc_id size text_crc32 law shard slot grown_shard old",
    "op10_weak_quality": "doc_id score kept",
    "op11_cross_tokenizer": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op12_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op13_ranked_search": "item_id rank doc_id score",
}


def test_registered():
    assert set(COLUMNS) == set(REGISTRY)
    assert {*COLUMNS, "pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(ORACLES)))
def test_columns(spark, name):
    frame = REGISTRY[name](spark, SF)
    assert frame.columns == COLUMNS[name].split()
    rows = frame.count()
    if name.split("_")[0] in ("op1", "op2", "op3", "op7", "op9", "op10", "op11", "op12"):
        assert rows == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    frame = REGISTRY[name](spark, SF)
    assert frame.columns == COLUMNS[name].split()
    assert compare(frame, connect(SF), ORACLES[name]) == ""


def test_stages(spark, documents, odd):
    docs = documents.unionByName(odd.select("doc_id", "text", "lang", "source"), allowMissingColumns=True)
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == documents.columns, name
        rows = after.count()
        assert rows <= before, name
        docs, before = spark.createDataFrame(after.collect(), documents.schema), rows
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.columns == ["doc_id", "ids", "n_bytes", "text_crc32"]
    decoded = sorted(((r.doc_id, r.n_bytes, r.text_crc32) for r in last.collect()), key=repr)
    texts = [(r.doc_id, (r.text or "").replace("▁", " ").encode()) for r in docs.collect()]
    assert decoded == sorted(((i, len(t), zlib.crc32(t)) for i, t in texts), key=repr)


def test_stages_of_an_empty_table_and_of_columns_with_internal_names(spark, documents):
    names = ["other_id", "cls", "token", "score", "kept", "key", "vertex", "n"]
    more = documents.limit(30).select("*", *[F.lit(name).alias(name) for name in names])
    for docs in (documents.limit(0), more):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SF)
            assert stage is corpus_pipeline.STAGES[-1][1] or after.columns == docs.columns, name
            assert after.count() <= docs.count()


def plain_words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def holds_an_item(words, items, weight, unseen):
    """Whether some passage of an item's length has a weighted Jaccard similarity of 0.8 with it."""
    own = set(plain_shingles(words)) if len(words) >= 5 else set()
    for item, grams in items:
        if len(item) >= 5 and not own & set(grams):
            continue
        for start in range(len(words)):
            window = plain_shingles(words[start : start + len(item)])
            every = grams | window
            both = sum(n * weight.get(g, unseen) for g, n in (grams & window).items())
            if both >= 0.8 * sum(n * weight.get(g, unseen) for g, n in every.items()):
                return True
    return False


def test_run_against_plain_python(spark, documents, monkeypatch):
    """Each stage of run() on what its predecessor kept: learned ones keep rows as they are, the others are told by hand."""
    import public_tokenizers
    import sentencepiece
    from test_signature_join import brute

    steps = [documents]

    def noted(frame, what):
        steps.append(stored(frame, what))
        return steps[-1]

    monkeypatch.setattr(corpus_pipeline, "stored", noted)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(steps) == 1 + len(corpus_pipeline.STAGES)
    kept = [{r.doc_id: r for r in step.collect()} for step in steps[:-1]]
    for before, after in zip(kept, kept[1:], strict=False):
        assert all(before[i] == row for i, row in after.items())
    judged = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, r in judged.items() if r.quality == 1 and not r.toxic]
    assert sum(i in kept[2] for i in good) >= 0.95 * len(good)
    component = {i: c for i, _, c in brute([(r.doc_id, r.text) for r in kept[2].values()])}
    assert set(kept[3]) == {i for i, c in component.items() if i == c} < set(kept[2])
    benchmark = {(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    items = [(words, plain_shingles(words)) for _, text in benchmark if (words := plain_words(text))]
    frequency = Counter(g for _, grams in items for g in grams)
    weight = {g: 1 + math.log(len(benchmark) / n) for g, n in frequency.items()}
    unseen = 1 + math.log(len(benchmark))
    clean = {i for i, r in kept[3].items() if not holds_an_item(plain_words(r.text), items, weight, unseen)}
    assert set(kept[4]) == clean < set(kept[3])
    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    expected = {}
    for i in clean:
        text = kept[3][i].text or ""
        data = text.replace("▁", " ").encode()
        expected[i] = (library.encode(text), len(data), zlib.crc32(data))
    assert len(rows) == len(expected)
    assert {r.doc_id: (r.ids, r.n_bytes, r.text_crc32) for r in rows} == expected


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        texts = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text", "'en' AS lang", "'a' AS source")
        corpus_pipeline.encoded(spark, texts, SF)
        found = [r["size"] for r in texts.select("text").mapInArrow(sizes, "size long").collect()]
        assert sum(found) > 20_000_000 and max(found) < 5_000_000
        spark.conf.set(key, "1m")
        corpus_pipeline.encoded(spark, texts, SF)
        assert spark.conf.get(key) in ("1m", "1048576", "1048576b")
    finally:
        spark.conf.unset(key)
        if had is not None:
            spark.conf.set(key, had)
