import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from resolver_audit.llm import toxicity
from resolver_audit.llm.queries import held_out
from resolver_audit.llm.toxicity import (
    PATTERNS,
    ToxicityModel,
    ToxicityTrainer,
    compose,
    kept,
    scored,
    seed_words,
    within,
)
from resolver_audit.llm.words import ALNUM, split_words


@pytest.fixture(scope="module")
def untaught():
    return ToxicityModel(seed_words(), [2.0, 2.5, 0.5, 0.5] * 2, -2.0)


def patterns(model, text):
    found = model.patterns(split_words(pa.array([text], pa.string()), ALNUM))[0]
    return {name: int(n) for name, n in zip(PATTERNS, found, strict=True) if n}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("You are an idiot.", {"aimed insult": 1}),
        ("The idiot came.", {"insult": 1}),
        ("This is not an idiot.", {"negated insult": 1}),
        ("He said it was a stupid plan", {"aimed insult": 1}),
        ("Somebody wrote that idiot here", {"reported insult": 1}),
        ("No. Idiot!", {"insult": 1}),
        ("I kill. You", {"threat": 1}),
        ("you should kill the moron", {"aimed threat": 1, "aimed insult": 1}),
        ("a fine day", {}),
        ("", {}),
        (None, {}),
    ],
)
def test_clauses(untaught, text, expected):
    found = patterns(untaught, text)
    if text and "said" in text:
        assert sum(found.values()) == 1
    else:
        assert found == expected


def test_composition_feeds_one_machine_to_the_next():
    first, then = within("negation", 2, "negated"), within("target", 2, "aimed")
    symbols = ["other", "insult", "threat", "target", "negation", "report"]
    both = compose(first, then, symbols)
    for text in (["negation", "insult"], ["target", "negation", "other", "insult", "insult"], ["target", "threat"]):
        state, a, b, got, expected = 0, 0, 0, [], []
        for symbol in text:
            out, state = both.step(state, symbol)
            got.append(out)
            out, a = first.step(a, symbol)
            out, b = then.step(b, out)
            expected.append(out)
        assert got == expected


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = ToxicityTrainer().fit(documents, labels.filter(~held_out(F.col("doc_id"))))
    rows = scored(documents.select("doc_id", "text", "lang"), model, "score").join(
        labels.filter(held_out(F.col("doc_id"))), "doc_id"
    )
    english = [r for r in rows.collect() if r.lang == "en"]
    assert all(r.score < 0.5 for r in english if not r.toxic)
    assert sum(r.score >= 0.5 for r in english if r.toxic) >= 0.8 * sum(r.toxic for r in english)


def test_odd_texts_and_no_labels(odd, nothing, untaught):
    none = odd.select("doc_id", F.lit(1).alias("toxic")).limit(0)
    model = ToxicityTrainer().fit(odd, none)
    rows = scored(odd, model, "score").collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert kept(odd, model).columns == odd.columns and kept(odd, model).count() == len(rows)
    assert scored(nothing, ToxicityTrainer().fit(nothing, none), "score").count() == 0


def test_held_out_recall_in_every_language(spark):
    folder = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = ToxicityTrainer().fit(documents, labels.filter(~held_out(F.col("doc_id"))))
    rows = scored(documents.select("doc_id", "text", "lang"), model, "score").join(
        labels.filter(held_out(F.col("doc_id"))), "doc_id"
    )
    found = {}
    for row in rows.collect():
        found.setdefault((row.lang, row.toxic), []).append(row.score >= 0.5)
    for lang in ("en", "de", "fr", "es"):
        toxic, clean = found[lang, 1], found[lang, 0]
        print(lang, sum(toxic), len(toxic), sum(clean), len(clean))
        assert sum(toxic) >= 0.8 * len(toxic), lang
        assert sum(clean) <= 0.02 * len(clean), lang


def test_neighbours_stay_within_a_text():
    """A text's contexts are the same whatever lies beside it."""

    def contexts(texts):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([0] * len(texts))], names=["text", "toxic"])
        return [tuple(row.values()) for out in toxicity._contexts(iter([batch])) for row in out.to_pylist()]

    texts = ["one two three", "", None, "four", "two three one two"]
    alone = [row for t in texts for row in contexts([t])]
    assert contexts(texts) == alone
    assert sorted(contexts(texts[::-1])) == sorted(alone)
