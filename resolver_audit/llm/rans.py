"""Token ids in compressed binary files: a static range asymmetric numeral system.

Documents are put in ascending order of doc_id, encoded with a tokenizer, and their ids
written as one stream in files. All files share one table of symbol frequencies. A block of
ids is coded by many interleaved states, so a block is coded and decoded with array
operations; blocks are independent, and each file ends with checkpoints (place and first id
of every block) and checksums, so that any run of blocks can be decoded alone.

File: MAGIC, then blocks, then the index as Parquet-free binary:
  block  = header (ids, words, crc32 of the ids), states of the lanes, 32-bit words
  index  = doc ids (int64; a null is the smallest number), ids in each document (int64),
           block offsets (int64), first id of each block (int64)
  footer = documents, blocks, offset of the index, crc32 of the index, crc32 of the table, MAGIC

Defined results: a null or empty text is the end id alone. A null doc_id comes first. Rows
with equal doc_id are ordered by a hash of their texts and each keeps its place. Other
columns play no part. An empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resolver_audit.llm.storage import file_system, shared_folder, stored
from resolver_audit.llm.words import VISIBLE, binary_parts, chunks, lowered

MAGIC = b"RANSIDS1"
LANES = 1024
SCALE_BITS = 20
_LOW = np.uint64(1 << 31)
_HEADER = struct.Struct("<QQI")
_FOOTER = struct.Struct("<QQQII8s")
NO_ID = np.iinfo(np.int64).min


@dataclass
class Table:
    """Frequencies scaled to a sum of 2**SCALE_BITS; symbols that occur have one at least."""

    frequency: np.ndarray
    _derived: tuple | None = None

    @staticmethod
    def of(counts: np.ndarray) -> Table:
        counts = np.asarray(counts, dtype=np.float64)
        total = 1 << SCALE_BITS
        if not counts.sum():
            counts = np.ones(1)
        scaled = np.where(counts > 0, np.maximum(1, np.floor(counts / counts.sum() * total)), 0).astype(np.int64)
        # Rounding is settled on the most frequent symbols, each of which gives at most half of its share.
        order = np.argsort(-scaled, kind="stable")
        rest = total - int(scaled.sum())
        for i in order:
            if not rest:
                break
            change = rest if rest > 0 else -min(-rest, int(scaled[i]) // 2)
            scaled[i] += change
            rest -= change
        if rest:
            raise ValueError(f"more than {total} symbols")
        return Table(scaled)

    def derived(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Frequencies and starts as 64-bit numbers, and the symbol of every slot."""
        if self._derived is None:
            start = np.cumsum(self.frequency) - self.frequency
            symbols = np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency)
            self._derived = self.frequency.astype(np.uint64), start.astype(np.uint64), symbols
        return self._derived

    @property
    def crc(self) -> int:
        return zlib.crc32(self.frequency.astype("<i8").tobytes())


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """Id i goes to lane i modulo LANES. Lanes are fed backwards, so that decoding runs forwards."""
    frequency, start, _ = table.derived()
    state = np.full(LANES, _LOW, dtype=np.uint64)
    shift, scale = np.uint64(32), np.uint64(SCALE_BITS)
    words = []
    f_all, s_all = frequency[ids], start[ids]
    if len(ids) and not f_all.all():
        raise ValueError("an id that the table does not hold")
    limit_all = f_all << np.uint64(63 - SCALE_BITS)
    for lo in range((len(ids) - 1) // LANES * LANES, -1, -LANES) if len(ids) else ():
        f, s = f_all[lo : lo + LANES], s_all[lo : lo + LANES]
        x = state[: len(f)]
        full = x >= limit_all[lo : lo + LANES]
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> shift, x)
        q = x // f
        state[: len(f)] = (q << scale) + (x - q * f) + s
    body = np.concatenate(words[::-1]) if words else np.zeros(0, dtype=np.uint32)
    head = _HEADER.pack(len(ids), len(body), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + state.astype("<u8").tobytes() + body.astype("<u4").tobytes()


def decode_block(data: bytes, table: Table) -> np.ndarray:
    frequency, start, symbols = table.derived()
    n, n_words, crc = _HEADER.unpack_from(data)
    state = np.frombuffer(data, "<u8", LANES, _HEADER.size).astype(np.uint64)
    words = np.frombuffer(data, "<u4", n_words, _HEADER.size + 8 * LANES).astype(np.uint64)
    out = np.zeros(n, dtype=np.uint32)
    mask, scale, shift = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    at = 0
    for lo in range(0, n, LANES):
        x = state[: min(LANES, n - lo)]
        slot = x & mask
        symbol = symbols[slot]
        out[lo : lo + len(x)] = symbol
        x = frequency[symbol] * (x >> scale) + slot - start[symbol]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << shift) | words[at : at + len(low)]
        at += len(low)
        state[: len(x)] = x
    # Every lane ends where its encoding began.
    if at != n_words or (state != _LOW).any() or zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of a block does not match")
    return out


class Writer:
    """Ids of documents in order; blocks go out as they fill."""

    def __init__(self, out, table: Table, block: int):
        self.out, self.table, self.block = out, table, block
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.offsets: list[int] = []
        self.firsts: list[int] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.at = out.write(MAGIC) or len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            rest = np.concatenate(self.held)
            while len(rest) >= self.block:
                self._write(rest[: self.block])
                rest = rest[self.block :]
            self.held, self.n_held = [rest.copy()], len(rest)

    def _write(self, ids: np.ndarray) -> None:
        data = encode_block(ids, self.table)
        self.offsets.append(self.at)
        self.firsts.append(self.n_ids)
        self.out.write(data)
        self.at += len(data)
        self.n_ids += len(ids)

    def close(self) -> int:
        """Writes the rest and the index; returns the size of the file."""
        if self.n_held:
            self._write(np.concatenate(self.held))
        parts = (self.ids, self.sizes, self.offsets, self.firsts)
        index = b"".join(np.array(x, dtype="<i8").tobytes() for x in parts)
        self.out.write(index)
        foot = _FOOTER.pack(len(self.ids), len(self.offsets), self.at, zlib.crc32(index), self.table.crc, MAGIC)
        self.out.write(foot)
        return self.at + len(index) + len(foot)


class Reader:
    """Random access to the blocks and documents of a file."""

    def __init__(self, source, size: int, table: Table):
        self.source, self.table = source, table
        source.seek(size - _FOOTER.size)
        n_docs, n_blocks, at, crc, table_crc, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC or table_crc != table.crc:
            raise ValueError("not a file of this table")
        source.seek(at)
        index = source.read(16 * (n_docs + n_blocks))
        if zlib.crc32(index) != crc:
            raise ValueError("checksum of the index does not match")
        numbers = np.frombuffer(index, "<i8")
        self.doc_ids, self.sizes = numbers[:n_docs], numbers[n_docs : 2 * n_docs]
        self.offsets = np.append(numbers[2 * n_docs : 2 * n_docs + n_blocks], at)
        self.firsts = numbers[2 * n_docs + n_blocks :]

    def block(self, k: int) -> np.ndarray:
        self.source.seek(int(self.offsets[k]))
        return decode_block(self.source.read(int(self.offsets[k + 1] - self.offsets[k])), self.table)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this file, ids), a block at a time."""
        held, k, start = np.zeros(0, dtype=np.uint32), 0, 0
        for doc_id, size in zip(self.doc_ids.tolist(), self.sizes.tolist(), strict=True):
            if len(held) < size:
                parts, n = [held], len(held)
                while n < size:
                    parts.append(self.block(k))
                    n += len(parts[-1])
                    k += 1
                held = np.concatenate(parts)
            yield (None if doc_id == NO_ID else doc_id), start, held[:size]
            held = held[size:]
            start += size


#: ASCII punctuation after which, and before which, a letter always starts a new word of the tokenizer's rule.
_LOOSE = np.zeros(256, dtype=bool)
_LOOSE[list(b".,;:!?%$&*#\"()")] = True
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[97:123] = True


class WordEncoder:
    """Encodes texts through the tokenizer by distinct words.

    The tokenizer lower-cases, drops white space and never joins letters with such
    punctuation, so a text's ids are those of its words in order. Words are encoded once and
    remembered up to a bound. Words of letters go through the tokenizer many in one text: each
    of them is at least one of its pieces, and a piece ends with the one token that is marked so.
    """

    MOST = 1_000_000
    #: Words of letters in one text.
    JOINED = 256

    def __init__(self, path: str):
        # Tasks run beside each other already; the library's threads would only wait for cores.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Tokens that end a piece; None if some piece might end without one.
        self.ending = None
        if suffix and all(x in vocabulary and x + suffix in vocabulary for x in pre_tokenizers.ByteLevel.alphabet()):
            self.ending = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ending[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.begin = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _numbers(self, distinct: list[str]) -> np.ndarray:
        if len(self.number) > self.MOST:
            self._clear()
        fresh = [w for w in distinct if w not in self.number]
        if fresh:
            joined, single = [], fresh
            if self.ending is not None:
                joined, single = [w for w in fresh if w.isalpha()], [w for w in fresh if not w.isalpha()]
            more = [self._joined(joined[lo : lo + self.JOINED]) for lo in range(0, len(joined), self.JOINED)]
            ids, sizes = zip(*more, self._singly(single), strict=True)
            fresh, sizes = joined + single, np.concatenate(sizes)
            self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh)), strict=True))
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, *ids])
        return np.fromiter(map(self.number.__getitem__, distinct), dtype=np.int64, count=len(distinct))

    def _singly(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has."""
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), dtype=np.int64, count=len(words))
        return np.array([i for e in encoded for i in e], dtype=np.uint32), sizes

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of letters, through one text; singly where the tokenizer parts one of them."""
        (encoded,) = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(encoded.ids, dtype=np.uint32)
        ends = np.flatnonzero(self.ending[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._singly(words)
        return ids, np.diff(ends, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts, and all their ids."""
        offsets, data = binary_parts(texts)
        if b"<|" not in data.tobytes():  # else it may hold a special token, whose case counts
            data = lowered(data)
        seen = VISIBLE[data]
        new = seen.copy()
        if len(data) > 1:
            loose, plain = _LOOSE[data], _PLAIN[data]
            new[1:] &= ~seen[:-1] | (plain[:-1] & loose[1:]) | (loose[:-1] & plain[1:])
            edges = offsets[1:-1]
            edges = edges[edges < len(data)]
            new[edges] = seen[edges]
        packed = np.zeros(len(seen) + 1, dtype=np.int32)
        np.cumsum(seen, dtype=np.int32, out=packed[1:])
        begins = np.flatnonzero(new)
        at = np.append(packed[begins], packed[-1])
        del packed
        words = pa.StringArray.from_buffers(
            len(begins), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[seen]))
        ).dictionary_encode()
        number = self._numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]
        size = self.begin[number + 1] - self.begin[number]
        ends = np.cumsum(size)
        source = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[number] - (ends - size), size)
        first = np.searchsorted(begins, offsets)
        return np.concatenate([[0], ends])[first], self.flat[source]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


@dataclass(frozen=True)
class TokenFiles:
    """tokenizer: path of its file on every machine. end: id after each document. block: ids in a block."""

    tokenizer: str
    end: int = 2
    block: int = 1 << 18

    def encoded(self, documents: DataFrame) -> DataFrame:
        """(part, seq, doc_id, ids): documents by ascending doc_id; part and seq give the order."""
        path, end = self.tokenizer, self.end

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part_no, seq = TaskContext.get().partitionId(), 0
            for batch in batches:
                for part in chunks(batch, limit=8 << 20):
                    n = part.num_rows
                    offsets, ids = encoder(path).encode(part.column("text"))
                    ids = np.insert(ids, offsets[1:], end).astype("<u4" if len(ids) and ids.max() > 0xFFFF else "<u2")
                    offsets = (offsets + np.arange(n + 1)) * ids.itemsize
                    blobs = pa.BinaryArray.from_buffers(
                        pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)]
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, part_no), pa.int32()), pa.array(np.arange(seq, seq + n)),
                            part.column("doc_id"), pa.array(np.full(n, ids.itemsize), pa.int32()), blobs,
                        ],
                        names=["part", "seq", "doc_id", "width", "ids"],
                    )
                    seq += n

        ordered = (
            documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .repartitionByRange(F.col("doc_id").asc_nulls_first())
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        )
        return ordered.mapInArrow(encode, "part int, seq long, doc_id long, width int, ids binary")

    def table(self, encoded: DataFrame) -> Table:
        """Frequencies over all documents; as many numbers as the vocabulary has come to the driver."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(0, dtype=np.int64)
            for batch in batches:
                for ids in _ids_of(batch):
                    more = np.bincount(ids, minlength=len(total))
                    more[: len(total)] += total
                    total = more
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

        rows = encoded.select("width", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        found = rows.toArrow()
        counts = np.zeros(max(found["id"].to_pylist(), default=0) + 1, dtype=np.int64)
        counts[found["id"].to_numpy()] = found["n"].to_numpy()
        return Table.of(counts)

    def write(self, documents: DataFrame, folder: str) -> tuple[DataFrame, Table]:
        """Writes the files; returns their manifest (file, part, seq, n_docs, n_ids, n_bytes) and the table.

        A task writes under a temporary name and renames, so a task that is run again only
        replaces a file by an equal one; the manifest names those that count.
        """
        spark = documents.sparkSession
        encoded = stored(self.encoded(documents), "token-ids")
        table = self.table(encoded)
        shared = spark.sparkContext.broadcast(table)
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/table.bin") as out:
            out.write(table.frequency.astype("<i8").tobytes())
        block = self.block

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, path = file_system(folder)
            writer, expected, first = None, None, None
            for batch in batches:
                parts, seqs = batch.column("part").to_pylist(), batch.column("seq").to_pylist()
                ids = batch.column("doc_id").to_pylist()
                for part, seq, doc_id, tokens in zip(parts, seqs, ids, _documents(batch), strict=True):
                    if (part, seq) != expected:
                        if writer is not None:
                            yield _finish(system, path, writer, temporary, first)
                        temporary, first = f"{path}/.tmp-{uuid.uuid4().hex}", (part, seq)
                        writer = Writer(system.open_output_stream(temporary), shared.value, block)
                    writer.add(doc_id, tokens)
                    expected = part, seq + 1
            if writer is not None:
                yield _finish(system, path, writer, temporary, first)

        schema = "file string, part int, seq long, n_docs long, n_ids long, n_bytes long"
        return stored(encoded.mapInArrow(write, schema), "token-manifest"), table

    def read(self, manifest: DataFrame, table: Table, folder: str) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
        shared = manifest.sparkSession.sparkContext.broadcast(table)
        before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
        files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
        n = max(1, manifest.count())

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, path = file_system(folder)
            for batch in batches:
                for row in batch.to_pylist():
                    rows = []
                    with system.open_input_file(f"{path}/{row['file']}") as source:
                        reader = Reader(source, row["n_bytes"], shared.value)
                        for doc_id, start, ids in reader.documents():
                            rows.append((doc_id, row["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            if len(rows) == 10_000:
                                yield _digests(rows)
                                rows = []
                    yield _digests(rows)

        return files.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def round_trip(self, documents: DataFrame) -> DataFrame:
        folder = shared_folder(documents.sparkSession, "token-files")
        manifest, table = self.write(documents, folder)
        return self.read(manifest, table, folder)


def _documents(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    blobs = batch.column("ids")
    for width, blob in zip(batch.column("width").to_pylist(), blobs, strict=True):
        yield np.frombuffer(blob.as_buffer(), "<u2" if width == 2 else "<u4")


def _ids_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """All ids of a batch, in pieces of a bounded number."""
    held, n = [], 0
    for ids in _documents(batch):
        held.append(ids)
        n += len(ids)
        if n > 1 << 20:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _finish(system, path: str, writer: Writer, temporary: str, first: tuple[int, int]) -> pa.RecordBatch:
    size = writer.close()
    writer.out.close()
    name = f"ids-{first[0]:06d}-{first[1]:012d}.rans"
    system.move(temporary, f"{path}/{name}")
    row = (name, *first, len(writer.ids), writer.n_ids, size)
    kinds = (pa.string(), pa.int32(), *[pa.int64()] * 4)
    arrays = [pa.array([v], k) for v, k in zip(row, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["file", "part", "seq", "n_docs", "n_ids", "n_bytes"])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    arrays = [pa.array(c, pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"])
