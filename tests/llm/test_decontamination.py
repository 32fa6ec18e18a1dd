import numpy as np
import pytest

from resolver_audit.llm.decontamination import Decontamination, bit_counts, index_of, simhashes
from resolver_audit.llm.words import mix


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def upper(text):
    return "".join(c.upper() if c.isascii() else c for c in text)


@pytest.fixture(scope="module")
def planted(spark, benchmark):
    """Items in upper case at odd places, with one word changed in long ones, cut ones, and clean texts."""
    items = {r.item_id: r.text for r in benchmark.collect()}
    rows, expected, doc = [], set(), 1000
    for n, (item, text) in enumerate(items.items()):
        filler = " ".join(f"filler{doc}x{i}" for i in range(n * 3))
        rows.append((doc, f"{filler} {upper(text)} {filler} {filler}"))
        expected.add((doc, item))
        words = text.split()
        rows.append((doc + 1, " ".join(words[: len(words) // 2]) + f" {filler}"))
        if len(words) >= 50:
            words[1] = "changed"
            rows.append((doc + 2, f"{filler} {' '.join(words)} {filler}"))
            expected.add((doc + 2, item))
        doc += 3
    rows.append((None, next(iter(items.values()))))
    expected.add((None, next(iter(items))))
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, similarity string"), expected


def test_planted_items(planted, benchmark):
    documents, expected = planted
    found = Decontamination().matches(documents, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    assert all(r.similarity >= 0.8 for r in found)
    stay = Decontamination().kept(documents, benchmark)
    assert stay.columns == documents.columns
    dirty = {d for d, _ in expected}
    assert {r.doc_id for r in stay.collect()} == {r.doc_id for r in documents.collect()} - dirty


def test_more_items_than_one_pass_takes(planted, benchmark):
    documents, expected = planted
    small = Decontamination(items=7)
    assert {(r.doc_id, r.item_id) for r in small.matches(documents, benchmark).collect()} == expected
    assert small.kept(documents, benchmark).count() == Decontamination().kept(documents, benchmark).count()


def test_all_documents(documents, benchmark):
    """Against plain search for items word by word."""
    import re

    def words(text):
        return " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())) + " "

    items = [(r.item_id, words(r.text)) for r in benchmark.collect()]
    exact = {(d.doc_id, i) for d in documents.collect() for i, text in items if text in words(d.text)}
    found = Decontamination().matches(documents, benchmark).collect()
    assert exact <= {(r.doc_id, r.item_id) for r in found}
    assert {(r.doc_id, r.item_id) for r in found if r.similarity == 1} == exact


def test_odd_texts(spark, odd, nothing):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two three"), (None, "naïve 漢字 🙂 x")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in Decontamination().matches(odd, items).collect()}
    assert found == {(12, 3), (13, 3), (14, None)}
    assert Decontamination().kept(odd, items).count() == odd.count() - 4
    assert Decontamination().matches(nothing, items).count() == 0
    assert Decontamination().matches(odd, items.limit(0)).count() == 0
    assert Decontamination().kept(odd, items.limit(0)).count() == odd.count()


def test_repeated_items_and_items_beyond_the_counters(spark, planted, benchmark):
    documents, expected = planted
    again = Decontamination(items=40).matches(documents, benchmark.union(benchmark).union(benchmark))
    once = Decontamination().matches(documents, benchmark)
    assert sorted(again.collect(), key=repr) == sorted(once.collect(), key=repr)
    words = [f"v{i * i % 70_001}" for i in range(70_000)]
    item = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts = [" ".join(["before", *words, "after"]), " ".join([*words[:50_000], "changed", *words[50_001:]]), " ".join(words[:50_000])]
    long = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.item_id, r.first_word, r.similarity >= 1) for r in Decontamination().matches(long, item).collect()}
    assert found == {0: (1, 1, True), 1: (1, 0, False)}
    assert [r.doc_id for r in Decontamination().kept(long, item).collect()] == [2]


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(1)
    index = index_of([(i, " ".join(f"t{i}w{k}" for k in range(40))) for i in range(30)], 4, 30)
    band = index.bands[0]
    found = band.prints[rng.integers(0, len(band.prints), 500)].copy()
    for i in range(len(found)):
        for bit in rng.choice(64, rng.integers(0, 7), replace=False):
            found[i] ^= np.uint64(1) << np.uint64(bit)
    near = set(zip(*(x.tolist() for x in band.near(found, 4)), strict=True))
    distance = np.bitwise_count(found[:, None] ^ band.prints[None, :])
    assert near == {(int(a), int(b)) for a, b in zip(*np.nonzero(distance <= 4), strict=True)}


def test_rolling_fingerprints():
    h = mix(np.arange(100, dtype=np.uint64))
    counts = bit_counts(h)
    for start in (0, 7, 80):
        bits = [sum((int(x) >> b) & 1 for x in h[start : start + 15]) > 7 for b in range(64)]
        assert int(simhashes(counts, np.array([start]), 15)[0]) == sum(1 << b for b, on in enumerate(bits) if on)


def edited(words, kind, rng):
    """Near copies: a word changed, dropped or put in around the middle, or words cut off an end."""
    n = len(words)
    at = int(n * rng.uniform(0.3, 0.7))
    cut = int(rng.integers(1, max(2, n // 8)))
    return {
        "changed": [*words[:at], "changed", *words[at + 1 :]],
        "dropped": words[:at] + words[at + 1 :],
        "put in": [*words[:at], "added", *words[at:]],
        "two changed": [*words[: n // 4], "changed", *words[n // 4 + 1 : 3 * n // 4], "changed", *words[3 * n // 4 + 1 :]],
        "cut start": words[cut:],
        "cut end": words[:-cut],
    }[kind]


@pytest.mark.parametrize("kind", ["changed", "dropped", "put in", "two changed", "cut start", "cut end"])
def test_near_copies_against_verification_at_every_word(kind):
    import pyarrow as pa

    from resolver_audit.llm.decontamination import matches, similarity
    from resolver_audit.llm.words import ALNUM, split_words

    rng = np.random.default_rng(len(kind))
    vocabulary = [f"w{i}" for i in range(3000)]
    lengths = [int(n) for n in rng.integers(6, 160, 60)] + [49, 50, 60, 97, 120] * 4
    items = [[str(w) for w in rng.choice(vocabulary, n)] for n in lengths]
    index = index_of([(i, " ".join(w)) for i, w in enumerate(items)], 4, len(items))
    texts = []
    for i, item in enumerate(items):
        before, after = ([str(w) for w in rng.choice(vocabulary, rng.integers(0, 40))] for _ in range(2))
        if i % 3 == 0:
            before, after = ([], after) if kind == "cut start" else (before, [])
        texts.append(" ".join([*before, *edited(item, kind, rng), *after]))
    words = split_words(pa.array(texts), ALNUM)
    expected = set()
    for doc, item in enumerate(items):
        lo, hi = words.first[doc : doc + 2]
        places = (similarity(index, doc, words.hashes[a : min(a + len(item), hi)]) for a in range(lo, hi))
        if max(places) >= 0.8:
            expected.add((doc, doc))
    assert len(expected) >= 20
    assert {(text, item) for text, item, *_ in matches(words, index, 4, 0.8)} == expected
