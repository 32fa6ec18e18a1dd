from itertools import product

import numpy as np
import pytest

from resolver_audit.llm import weak_quality
from resolver_audit.llm.weak_quality import CLEAN, JUNK, NOTHING, WeakQuality, estimated, kept, scored


def test_expectation_maximisation_finds_known_accuracies():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.2
    right = np.array([[0.7, 0.97], [0.6, 0.95], [0.8, 0.99], [0.5, 0.98]])
    votes = []
    for on_junk, on_clean in right:
        hit = rng.random(len(truth)) < np.where(truth, on_junk, on_clean)
        vote = np.where(hit == truth, JUNK, CLEAN)
        votes.append(np.where(rng.random(len(truth)) < 0.1, NOTHING, vote))
    patterns, counts = np.unique(np.stack(votes, axis=1), axis=0, return_counts=True)
    model = estimated(patterns, counts.astype(float))
    assert abs(model.prior - 0.2) < 0.03
    assert np.abs(model.right - right).max() < 0.06


def test_labels_that_it_never_saw(spark):
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = WeakQuality().fit(documents)
    rows = scored(documents, model, "score").join(labels, "doc_id").select("quality", "score").collect()
    good, junk = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean(np.array(good) >= 0.5) == 1 and np.mean(np.array(junk) < 0.5) > 0.9
    stay = kept(documents, model)
    assert stay.columns == documents.columns
    assert stay.count() == scored(documents, model, "score").filter("score >= 0.5").count()


def test_odd_texts(odd, nothing):
    model = WeakQuality().fit(odd)
    rows = scored(odd, model, "score").collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 for r in rows if not (r.text or "").strip())
    assert scored(nothing, WeakQuality().fit(nothing), "score").count() == 0


def test_copies_come_to_the_driver_once_and_count_as_often(spark, documents, monkeypatch):
    """The scorer is the same as if all copies were taught one by one."""
    some = [r.text for r in documents.limit(60).collect()]
    rows = [(i, t) for i, t in enumerate(some * 2 + ["buy now!!! $$$ click @@@ here"] * 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    fit = weak_quality.trained

    def watched(taught, rounds, decay):
        seen.append(taught.collect())
        return fit(taught, rounds, decay)

    monkeypatch.setattr(weak_quality, "trained", watched)
    model = WeakQuality().fit(frame)
    assert len(seen[0]) == len({t for _, t in rows}) and sum(r.n for r in seen[0]) == len(rows)
    # Plain gradient steps of the same kind, over every copy.
    cells = [(r.junk, list(zip(r.bucket, r.value, strict=True))) for r in seen[0] for _ in range(r.n)]
    w, bias, sw, sb = np.zeros(weak_quality.BUCKETS), 0.0, np.full(weak_quality.BUCKETS, 1e-8), 1e-8
    for _ in range(20):
        g, gb = 1e-4 * w, 0.0
        for y, x in cells:
            z = sum(w[k] * v for k, v in x) + bias
            e = (1 / (1 + np.exp(-z)) - y) / len(cells)
            gb += e
            for k, v in x:
                g[k] += e * v
        sw, sb = sw + g * g, sb + gb**2
        w, bias = w - 0.5 * g / np.sqrt(sw), bias - 0.5 * gb / np.sqrt(sb)
    taught = spark.createDataFrame(seen[0], "h long, n long, junk double, bucket array<long>, value array<double>")
    ours, our_bias = fit(taught, 20, 1e-4)
    assert np.abs(ours - w).max() < 1e-6 and our_bias == pytest.approx(bias, abs=1e-6)
    assert model.weights.shape == w.shape


def test_estimates_equal_those_by_single_documents():
    """Counts of patterns and the same documents one by one give the same model."""
    patterns = np.array(list(product((JUNK, CLEAN, NOTHING), repeat=3)))
    counts = np.arange(1, len(patterns) + 1)
    together = estimated(patterns, counts.astype(float))
    apart = estimated(np.repeat(patterns, counts, axis=0), np.ones(counts.sum()))
    assert together.prior == pytest.approx(apart.prior, abs=1e-9)
    assert np.abs(together.right - apart.right).max() < 1e-9
