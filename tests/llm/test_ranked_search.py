import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from resolver_audit.llm import ranked_search
from resolver_audit.llm.ranked_search import Items, RankedSearch, Searcher, Shard, Weights

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(documents, items, k):
    counted = [(i, Counter(terms(t))) for i, t in documents]
    n_docs = sum(bool(c) for _, c in counted)
    n_words = sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    rows = []
    for item, held in wanted.items():
        scored = []
        for doc_id, c in counted:
            score = 0
            for t in held & c.keys():
                m = 50 + 50 * c.total() * n_docs // n_words
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += weight * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0 and doc_id is not None:
                scored.append((-score, doc_id))
        rows += [(item, rank, doc, -s) for rank, (s, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(rows, key=repr)


def check(documents, items, search):
    found = [tuple(r) for r in search.search(documents, items).select("item_id", "rank", "doc_id", "score").collect()]
    rows = [[tuple(r) for r in frame.select(*frame.columns[:2]).collect()] for frame in (documents, items)]
    assert sorted(found, key=repr) == expected(*rows, search.k)


@pytest.mark.parametrize(("k", "block_bytes", "shard"), [(50, 1 << 22, 1 << 13), (3, 1 << 11, 16)])
def test_documents(spark, documents, monkeypatch, k, block_bytes, shard):
    monkeypatch.setattr(ranked_search, "SHARD", shard)
    monkeypatch.setattr(ranked_search, "BLOCK", 8)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    check(documents.select("doc_id", "text"), items.select("item_id", "text"), RankedSearch(k, block_bytes))


def test_odd_texts(spark, odd, nothing):
    items = [(1, "one three, WORD5 word7"), (1, "漢字 x"), (2, None), (3, ""), (None, "end"), (4, "absent"), (4, "absent")]
    frame = spark.createDataFrame([(*row, 1.0) for row in items], "item_id long, text string, score double")
    check(odd, frame, RankedSearch())
    assert RankedSearch().search(nothing, frame).count() == 0
    assert RankedSearch().search(odd, frame.limit(0)).count() == 0


def test_documents_of_one_source_and_ties(spark):
    rows = [(i, "alpha beta " + "gamma " * (i % 3)) for i in range(300)] + [(1000, "alpha delta"), (5, "alpha delta")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(1, "alpha delta"), (2, "gamma"), (3, "beta")], "item_id long, text string")
    check(documents, items, RankedSearch(k=10))


def test_documents_below_the_threshold_are_skipped():
    """Of documents that only a frequent term names, few are looked up once the threshold is known."""
    rng = np.random.default_rng(5)
    n, rare = 4000, set(rng.choice(4000, 60, replace=False).tolist())
    held = [[0, 1] if i in rare else [0] for i in range(n)]
    rows = pa.table(
        {
            "doc_id": pa.array(range(n), pa.int64()),
            "n": pa.array(rng.integers(5, 50, n)),
            "term": pa.array(held, pa.list_(pa.int32())),
            "tf": pa.array([[1] * len(x) for x in held], pa.list_(pa.int32())),
        }
    )
    weights = Weights(n, 27 * n, np.array([700, 4000]))
    items = Items([1], np.array([0, 2]), np.array([0, 1], dtype=np.int32), np.array([1, 2]))
    searcher = Searcher(items, 50)
    searcher.search(Shard(rows, weights))
    assert searcher.looked_up <= 60
    assert set(searcher.best[0].doc_ids.tolist()) <= rare


def test_lengths_beyond_64_bits():
    n = np.array([10, 4_000_000])
    big = Weights(10**12, 10**15, np.zeros(1))
    m = [50 + 50 * int(x) * 10**12 // 10**15 for x in n]
    assert big.impacts(n, np.array([1, 2])).tolist() == [10**9 * t // (1000 * t + 20 * x) for t, x in zip((1, 2), m, strict=True)]
