import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from resolver_audit.llm.words import ALNUM, VISIBLE, chunks, grams_within, split_words

PATTERNS = ((ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (VISIBLE, r"[^\x20\x09-\x0D]+"))
TEXTS = st.lists(st.none() | st.text(alphabet="aB9 \n\t.é漢!|", max_size=30), max_size=6)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    for kind, pattern in PATTERNS:
        words = split_words(pa.array(texts, pa.string()), kind)
        for i, text in enumerate(texts):
            assert [w.decode() for w in words.text_of(i)] == re.findall(pattern, lower(text))


@given(TEXTS)
@settings(max_examples=100, deadline=None)
def test_equal_words_have_equal_hashes(texts):
    words = split_words(pa.array(texts, pa.string()), VISIBLE)
    flat = [w for i in range(len(texts)) for w in words.text_of(i)]
    assert len(set(flat)) == len(np.unique(words.hashes))
    place, grams = grams_within(words, 2)
    pairs = [(a, b) for i in range(len(texts)) for a, b in zip(words.text_of(i), words.text_of(i)[1:])]
    assert len(pairs) == len(place) and len(set(pairs)) == len(np.unique(grams))


def test_chunks_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "", "c"]})
    assert pa.Table.from_batches(chunks(batch, limit=12)).to_pydict() == batch.to_pydict()
