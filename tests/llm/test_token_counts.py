import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from resolver_audit.llm import token_counts
from resolver_audit.llm.token_counts import Counter, Scan, TokenCounts, counter, doubled

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    None, "", " \n\t", "Hello world", "it's we'll I'VE they'd'd ''s !'s 's's 'red", "<|startoftext|>a<|endoftext|>b c",
    "<|endoftext|><|endoftext|>", "<|END", "ümlaut – naïve 漢字 🙂 x", "é́ é ﬁ İstanbul ΣΑΣ ½ ²3 ٣٤", "가 가",
    "x" * 3000, "ab" * 2000, "12345 1a2b", "\x00\x1c\x85\xa0z", "a b c　d", "'", "''", "'s", "a'", "‍﻿q",
    "QUICK brown", "aGVsbG8gd29ybGQ" * 300, "🙂" * 400,
]


def expected(texts):
    return [len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for t in texts]


def check(frame, limit=2048):
    rows = frame.select("doc_id", "text").collect()
    texts = [r.text for r in rows]
    wanted = [
        (r.doc_id, len((r.text or "").encode()), n, n > limit) for r, n in zip(rows, expected(texts), strict=True)
    ]
    found = [tuple(r) for r in TokenCounts(PATH, limit).count(frame).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


def test_texts(spark):
    check(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), limit=5)


def test_documents(documents):
    check(documents)


def test_odd_texts(odd, nothing):
    check(odd)
    assert TokenCounts(PATH).count(nothing).count() == 0


def test_forgetting_changes_nothing(monkeypatch, documents):
    monkeypatch.setattr(token_counts, "TRANSITIONS", 10)
    monkeypatch.setattr(token_counts, "PART", 50)
    texts = [r.text for r in documents.select("text").limit(40).collect()]
    fresh = Counter(PATH)
    assert [int(fresh.counts([t])[0]) for t in texts] == expected(texts)


@given(st.lists(st.text(alphabet="abeinorst 'dlmv19.!\né́A<|>", max_size=60), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_any_text(texts):
    assert counter(PATH).counts(texts).tolist() == expected(texts)


@given(st.lists(st.text(max_size=30), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_any_character(texts):
    assert counter(PATH).counts(texts).tolist() == expected(texts)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64])
def test_chunks_of_any_size(chunk):
    """Long words span many chunks, whose state maps have to be composed."""
    texts = ["x" * 500 + " yes", "agvsbg8gd29ybgq" * 40, "the quick", "abab" * 90, "n"]
    tool = counter(PATH)
    scan = Scan(tool.transducer, *tool.splitter.streams(texts), chunk=chunk)
    assert scan.counts().tolist() == expected(texts)


def test_states_are_shared():
    """Words of any length need a bounded number of states where they repeat themselves."""
    fresh = Counter(PATH)
    fresh.counts(["x" * 4000])
    after = len(fresh.transducer.states)
    fresh.counts(["x" * 40000])
    assert len(fresh.transducer.states) == after < 400


def test_doubling_sums_along_jumps():
    counts, ends = doubled(np.array([1, 2, 3, 4, 0]), np.array([1, 2, 4, 4, 4]))
    assert counts.tolist() == [6, 5, 3, 4, 0] and ends.tolist() == [4] * 5
    lone, ends = doubled(np.array([5, 0]), np.array([1, 1]))
    assert lone.tolist() == [5, 0] and ends.tolist() == [1, 1]
