import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from resolver_audit.llm.rans import Reader, Table, TokenFiles, WordEncoder, decode_block, encode_block
from resolver_audit.llm.storage import file_system

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(PATH)


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 5000, 70_000])
def test_blocks(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 49_408).astype(np.uint32)
    table = Table.of(np.bincount(ids, minlength=49_408))
    data = encode_block(ids, table)
    assert (decode_block(data, table) == ids).all()
    if n:
        with pytest.raises(ValueError, match="checksum"):
            decode_block(data[:-1] + bytes([data[-1] ^ 1]) if n > 5000 else data[:16] + b"\0\0\0\0" + data[20:], table)


def test_compression_is_near_the_entropy():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.5, 200_000) % 5000).astype(np.uint32)
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    assert 8 * len(encode_block(ids, Table.of(counts))) < 1.02 * len(ids) * -(p * np.log2(p)).sum() + 64 * 1024 + 1000


@pytest.mark.parametrize("counts", [[5], [1, 0, 0], [1] * 50_000, [10**12, 1, 0, 1], [0, 0]])
def test_tables_sum_to_their_scale(counts):
    table = Table.of(np.array(counts))
    assert table.frequency.sum() == 1 << 20
    if sum(counts):
        assert ((table.frequency > 0) == (np.array(counts) > 0)).all()


@given(st.lists(st.none() | st.text(alphabet="aBÉé漢 \n\t.,'\"s!<|>0²́İΣ…-", max_size=25), max_size=5))
@example(["<|endoftext|> <|ENDOFTEXT|>", "It's o'clock, don't!! 3.14 a.b \"q\" (x)'s É,a", None, ""])
@settings(max_examples=300, deadline=None)
def test_words_give_the_ids_of_whole_texts(texts):
    encoder = test_words_give_the_ids_of_whole_texts.encoder
    offsets, ids = encoder.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        whole = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids[offsets[i] : offsets[i + 1]].tolist() == whole


test_words_give_the_ids_of_whole_texts.encoder = WordEncoder(PATH)


def brute(rows, encoder):
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_documents(documents, encoder):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    found = TokenFiles(PATH, block=4096).round_trip(documents.repartition(6)).collect()
    assert sorted(map(tuple, found)) == brute(rows, encoder)


def test_odd_texts(odd, nothing, encoder):
    found = [tuple(r) for r in TokenFiles(PATH).round_trip(odd).collect()]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(found, key=lambda r: r[1]) == brute(rows, encoder)
    assert TokenFiles(PATH).round_trip(nothing).count() == 0


def test_blocks_decode_alone(documents, tmp_path):
    files = TokenFiles(PATH, block=2000)
    manifest, table = files.write(documents, str(tmp_path))
    system, path = file_system(str(tmp_path))
    for row in manifest.collect():
        with system.open_input_file(f"{path}/{row.file}") as source:
            reader = Reader(source, row.n_bytes, table)
            whole = np.concatenate([ids for _, _, ids in reader.documents()])
            for k in reversed(range(len(reader.firsts))):
                block = reader.block(k)
                assert (whole[reader.firsts[k] : reader.firsts[k] + len(block)] == block).all()
    assert sum(r.n_docs for r in manifest.collect()) == documents.count()


def test_words_of_letters_are_encoded_in_one_text():
    """Words of letters share a text; one that the tokenizer parts (a dotted capital I) does no harm."""
    from tokenizers import Tokenizer

    words = ["the", "naïve", "漢字", "İstanbul", "ŉ", "ǆ", "Straße", "abc1", "don't", "12", "🙂", "ﬁne", "ªº", "zzzqqq"]
    plain, encoder, calls = Tokenizer.from_file(PATH), WordEncoder(PATH), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return plain.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counted()
    for some in (words, [f"{a}{b}" for a in "abcdefgh" for b in ("the", "ing", "é")]):
        calls.clear()
        number = encoder._numbers(some)
        found = [encoder.flat[encoder.begin[n] : encoder.begin[n + 1]].tolist() for n in number]
        assert found == [plain.encode(w, add_special_tokens=False).ids for w in some]
    assert calls == [1, 0]
