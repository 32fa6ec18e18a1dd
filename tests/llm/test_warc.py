import gzip
import hashlib
import io
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from resolver_audit.llm.warc import WarcArchive, clean, compressed, members, parsed, record, row_of

BIG = "<html>" + "ä" * 700 + "</html>"
ROWS = [
    (1, "http://a/1", BIG), (5, "http://a/5", BIG), (3, None, BIG), (2, "http://b", "x" * 999), (4, "http://c", "x" * 999),
    (6, "http://d", None), (7, "a\r\nb: c", ""), (8, "u", "y" * 1000), (9, "u", "y" * 1000), (9, "u", "y" * 1000),
    (None, "n", BIG), (10, "WARC/1.1\r\n\r\n", "WARC/1.1\r\n\r\n"), (11, "long", "z" * 300_000),
]
SCHEMA = "page_id long, url string, html string, digest string, target int"


def brute(rows):
    largest = {}
    for page, _, html in rows:
        if page is not None:
            largest[html or ""] = max(page, largest.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        to = largest.get(html or "") if len(data) >= 1000 else None
        to = None if to == page else to
        kind = "response" if to is None else "revisit"
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), kind, to))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "d", 1) for r in ROWS], SCHEMA)


def test_round_trip(pages):
    assert sorted(map(tuple, WarcArchive().round_trip(pages).collect()), key=repr) == brute(ROWS)


def test_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, WarcArchive(roll=20_000).round_trip(pages).collect()), key=repr) == brute(rows)


def test_no_pages(pages):
    assert WarcArchive().round_trip(pages.limit(0)).count() == 0


def test_same_bytes_again_and_files_of_bounded_size(pages, tmp_path):
    names = []
    for run in ("one", "two"):
        manifest = WarcArchive(roll=600).write(pages.repartition(5), str(tmp_path / run)).collect()
        names.append({r.file: (r.n_bytes, r.sha1) for r in manifest})
        files = {p.name: p for p in (tmp_path / run).iterdir()}
        assert set(files) == set(names[-1])
        for r in manifest:
            data = files[r.file].read_bytes()
            assert (len(data), hashlib.sha1(data).hexdigest()) == (r.n_bytes, r.sha1)
            assert len(data) <= 600 or r.n_records == 1
            assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == r.n_records
    assert names[0] == names[1] and len(names[0]) > 2


def test_a_damaged_record_is_found(pages, tmp_path):
    manifest = WarcArchive().write(pages, str(tmp_path))
    path = next(Path(tmp_path).iterdir())
    data = gzip.decompress(path.read_bytes())
    path.write_bytes(gzip.compress(data.replace(b"xxx", b"xyx", 1)))
    with pytest.raises(Exception, match="digest"):
        WarcArchive().read(manifest, str(tmp_path)).collect()


@given(st.lists(st.binary(max_size=400), max_size=8), st.integers(1, 64))
@settings(max_examples=80, deadline=None)
def test_members_in_pieces(blocks, piece):
    data = b"".join(compressed(b, 6) for b in blocks)
    assert list(members(io.BytesIO(data), piece)) == blocks


@given(st.none() | st.integers(-(1 << 63), (1 << 63) - 1), st.none() | st.text(max_size=30), st.text(max_size=80), st.none() | st.integers(0, 99))
@settings(max_examples=100, deadline=None)
def test_record(page, url, html, refers_to):
    data = record(page, url, html.encode(), refers_to)
    headers, block = parsed(data)
    assert headers["WARC-Target-URI"] == clean(url) and int(headers["Content-Length"]) == len(block)
    kind = "response" if refers_to is None else "revisit"
    assert row_of(data) == (page, len(html.encode()), hashlib.sha1(html.encode()).hexdigest(), kind, refers_to)
