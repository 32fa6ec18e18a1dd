import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from resolver_audit.llm.components import components
from resolver_audit.llm.signature_join import SignatureJoin, bitmap, bucket_pairs, representatives

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def brute(rows):
    """Components of (doc_id, text) by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    least = {i: i for i, _ in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=repr)


def check(frame, join=None):
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    found = (join or SignatureJoin()).join(frame).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute(rows)


def edited(rng, words, n):
    words = list(words)
    for at in rng.integers(0, len(words), n):
        words[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies(spark):
    """A large group of near copies of one text, chains, a shared passage, and unlike texts."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 500, 150)]
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [edited(rng, base, int(rng.integers(0, 7))) for _ in range(120)]
    texts += [" ".join(f"u{k}x{i}" for i in range(rng.integers(3, 60))) + " " + passage for k in range(60)]
    texts += [" ".join(f"c{i}" for i in range(k, k + 60)) for k in range(0, 40, 2)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_copies(copies):
    check(copies)


def test_copies_in_small_trees_without_pivots(copies):
    check(copies, SignatureJoin(block=7, fan=3, rounds=0))


def test_documents(documents):
    check(documents)


def test_odd_texts(odd, nothing):
    check(odd)
    check(nothing)
    stay = representatives(odd, SignatureJoin())
    assert stay.columns == odd.columns
    ids = sorted((r.doc_id for r in stay.select("doc_id").collect()), key=repr)
    assert ids == sorted([7, 8, 9, 10, 12, None, 14, 15, 16], key=repr)


def test_columns_with_internal_names(spark):
    names = ["other_id", "OTHER_ID_", "wanted_id", "cls", "token", "c", "component_id", "vertex"]
    rows = [(1, "a b c d e f g", *names), (2, "a b c d e f g", *names), (3, "x y", *names)]
    frame = spark.createDataFrame(rows, ["doc_id", "text", *names])
    stay = representatives(frame, SignatureJoin())
    assert stay.columns == frame.columns
    assert sorted(r.doc_id for r in stay.collect()) == [1, 3]


def test_components(spark):
    edges = [(5, 4), (4, 9), (9, 30), (7, 8), (8, 7), (100, 7), (1, 1), *((i, i + 1) for i in range(200, 300))]
    found = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {4: 4, 5: 4, 9: 4, 30: 4, 7: 7, 8: 7, 100: 7, **{i: 200 for i in range(200, 301)}}


SETS = st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=1, max_size=25)


@given(SETS, st.integers(2, 5), st.booleans(), st.randoms())
@settings(max_examples=150, deadline=None)
def test_trees_lose_no_pair(sets, fan, split, random):
    sets.sort(key=len)
    component = [random.randrange(3) for _ in sets]
    own = [random.randrange(2) if split else 0 for _ in sets]
    group = pa.table({
        "own": own, "x": [0] * len(sets), "y": [int(split)] * len(sets), "cls": list(range(len(sets))),
        "n": [len(s) for s in sets], "component": component,
        "bitmap": [bitmap(np.array(sorted(s), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in sets],
    })
    a, b = bucket_pairs(group, 80, fan)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    for i in range(len(sets)):
        for j in range(i):
            links = 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
            if links and component[i] != component[j] and (not split or own[i] != own[j]):
                assert (j, i) in found
