import re
from collections import Counter

from resolver_audit.llm.license_scan import LicenseScan, common_words

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def brute(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for label, phrase in BASE.items():
        phrase = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        places += here
        labels |= {label} if here else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(frame, rows):
    found = LicenseScan().scan(frame).collect()
    expected = Counter((i, *brute(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == expected
    for r in found:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert (r.score > 0) == bool(r.labels)
    return {r.doc_id: r for r in found}


def test_documents(documents):
    check(documents, [(r.doc_id, r.text) for r in documents.collect()])


def test_odd_texts(odd):
    check(odd, [(r.doc_id, r.text) for r in odd.collect()])


def test_places_and_near_matches(spark):
    gpl = "free software: you can redistribute it and/or modify it, under the terms of the GNU General Public License"
    rows = [
        (1, "cc by nc cc by nc, CC-BY-NC"),
        (2, "Under the MIT license under the MIT License."),
        (3, gpl),
        (4, gpl.replace("can redistribute", "may well redistribute")),
        (5, "free software you can eat"),
        (6, "under the the mit license"),
    ]
    found = check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert found[3].labels == "gpl" and found[3].score == 1
    assert found[4].labels == "gpl" and 0.8 <= found[4].score < 1
    assert found[5].labels == found[6].labels == ""


def test_repeated_rows_vote_once_and_stay(spark):
    """Half of the words of a longer phrase: twice the votes must not make it a span."""
    rows = [(1, "use is permitted under the MIT license")] * 3 + [(2, "redistribution and use in source")] * 4 + [(None, None)] * 2
    found = LicenseScan().scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_base, r.labels) for r in found) == {(1, 1, "mit"): 3, (2, 0, ""): 4, (None, 0, ""): 2}


def test_no_rows(nothing):
    assert LicenseScan().scan(nothing).count() == 0


def test_common_words():
    assert common_words(list("abcde"), list("axcye")) == 3
