import bisect
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from resolver_audit.llm.cross_tokenizer import CrossTokenizer, Encoders, align, galloped, parts

A = str(public_tokenizers.path("byte_bpe_50k.json"))
B = str(public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = [
    "Hello  world\n a\t b", " x", "", None, "  ", "naïve é 漢字 🙂", "a▁b", "\n\n x\n", "<|endoftext|> and <s> </s>",
    "it's we'll I'VE", "x" * 300, "1234567 89", "   wide", "é ́", "\x00 nul", "ﬁne ½",
]


def expected(rows):
    """Plain Python: every pair of tokens is compared by its byte range."""
    tools = Encoders(A, B)
    split, count = [], Counter()
    for doc_id, text in rows:
        a = tools.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = tools.b.encode(text) if text else []
        whole = b" " + (text or "").encode()
        if b"".join(tools.bytes_a[i] for i in a) != whole or b"".join(tools.bytes_b[i] for i in b) != whole:
            a, b = [], []
        ends_a = np.cumsum([len(tools.bytes_a[i]) for i in a]).tolist()
        ends_b = np.cumsum([len(tools.bytes_b[i]) for i in b]).tolist()
        links = []
        for i, end in enumerate(ends_a):
            begin = ends_a[i - 1] if i else 0
            for j in range(bisect.bisect_right(ends_b, begin), len(b)):
                if (ends_b[j - 1] if j else 0) >= end:
                    break
                links.append((a[i], b[j]))
        count.update(links)
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, at_a, at_b = [], 0, 0
        for cut in cuts:
            to_a, to_b = bisect.bisect_right(ends_a, cut), bisect.bisect_right(ends_b, cut)
            groups.append(",".join(map(str, a[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
            at_a, at_b = to_a, to_b
        split.append((doc_id, len(a), len(b), groups, links))
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    return sorted(
        (
            (
                doc_id, n_a, n_b, len(groups), len(links), sum(count[x] == highest[x[1]] for x in links),
                sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
            )
            for doc_id, n_a, n_b, groups, links in split
        ),
        key=repr,
    )


def check(frame, aligner):
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    assert sorted(map(tuple, aligner.align(frame).collect()), key=repr) == expected(rows)


def test_texts(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    check(frame, CrossTokenizer(A, B))


def test_documents_in_small_chunks(documents):
    check(documents, CrossTokenizer(A, B, chunk_bytes=30_000))


def test_odd_texts(odd, nothing):
    check(odd, CrossTokenizer(A, B))
    assert CrossTokenizer(A, B).align(nothing).count() == 0


def test_parts_are_encoded_alike():
    text = " ".join(f"word{i}, it's {i} a b  c\nd" for i in range(2000))
    cut = parts(text, 1000)
    assert len(cut) > 10 and " ".join(cut) == text
    tools = Encoders(A, B)
    ids_a, ids_b = tools.encode(cut)
    whole_a, whole_b = tools.encode([text])
    assert [i for x in ids_a for i in x] == whole_a[0]
    assert [i for x in ids_b for i in x] == whole_b[0]


@given(st.lists(st.integers(1, 60), min_size=1, max_size=60, unique=True), st.data())
@settings(max_examples=200, deadline=None)
def test_galloping_finds_the_first_place(ends, data):
    ends = np.array(sorted(ends))
    keys = np.array(data.draw(st.lists(st.integers(0, int(ends[-1])), min_size=1, max_size=20)))
    guess = np.array(data.draw(st.lists(st.integers(0, len(ends) - 1), min_size=len(keys), max_size=len(keys))))
    assert galloped(keys, ends, guess).tolist() == np.searchsorted(ends, keys).tolist()


@given(st.lists(st.tuples(st.sets(st.integers(1, 30)), st.sets(st.integers(1, 30)), st.integers(31, 33)), max_size=4))
@settings(max_examples=200, deadline=None)
def test_links_are_the_overlaps(documents):
    ends, first, base = ([], []), ([0], [0]), 0
    links = set()
    for inner_a, inner_b, total in documents:
        mine = [sorted({*inner_a, total}), sorted({*inner_b, total})]
        at = [len(ends[0]), len(ends[1])]
        for side in (0, 1):
            ends[side].extend(base + e for e in mine[side])
            first[side].append(len(ends[side]))
        for i, e in enumerate(mine[0]):
            for j, f in enumerate(mine[1]):
                if max(([0] + mine[0])[i], ([0] + mine[1])[j]) < min(e, f):
                    links.add((at[0] + i, at[1] + j))
        base += total
    found = align(*(np.array(x, dtype=np.int64) for pair in zip(ends, first, strict=True) for x in pair))
    pairs = list(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True))
    assert len(pairs) == len(set(pairs)) and set(pairs) == links
    common = sorted(set(ends[0]) & set(ends[1]))
    assert [ends[0][i] for i in found.common_a] == common == [ends[1][j] for j in found.common_b]
