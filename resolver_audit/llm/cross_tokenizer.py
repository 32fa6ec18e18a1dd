"""Aligns the tokens that two tokenizers make of the same text, and finds each id's usual partner.

Both tokenizers read a space and the text; A is a byte-level tokenizer of the tokenizers library,
B a SentencePiece model, which adds the space itself. Tokens are compared by the byte offsets at
which they end. Of the two lists of ends the shorter one drives: each of its ends is looked up in
the longer one by a galloping search, steps of 1, 2, 4, ... from where it is expected and then a
binary search between the last two steps. Ends found in both lists cut the tokens into groups. The
difference of two neighbouring ranks is the range of the longer list's tokens that overlap a token
of the shorter one: these overlaps are the links. All of it runs on the arrays of many documents.

Across documents, links are counted by id pair. A task encodes its texts in chunks of chunk_bytes
and stores per document which pairs of its chunk it holds, and per chunk its distinct pairs with
their numbers. Pairs are added up over the chunks, each B id's highest number is found, and every
chunk gets its own pairs' totals back. A pair stands in a chunk once, so no pair is hot however
often it occurs; a B id has at most as many pairs as A has ids; documents meet their totals chunk
by chunk, and a chunk is bounded by its bytes (one longer text is a chunk of its own).

No token of either tokenizer crosses a single blank between characters that are no white space.
So texts are cut there: into parts, which bound the arrays of a long text, and into words, of
which each distinct one is encoded once.

Defined results: texts null or empty, or which one of the tokenizers does not give back byte for
byte (say, with U+2581 in them), have no tokens: zeros and an empty digest. Each row counts and
has its own result, also repeated rows; a null doc_id stays null. Other columns play no part. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resolver_audit.llm.storage import stored

#: Characters of text that are given to the tokenizers at once.
PART = 1 << 16
BATCH = 1 << 18
#: Distinct words whose ids a task remembers.
WORDS = 1 << 17
#: Words that are encoded as one text.
LOT = 1 << 13
_CUT = re.compile(r" (?=\S)(?<=\S )")
_ODD = re.compile(r"\s | \s")

DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long"
ENCODED = f"chunk long, {DOCUMENT}, groups_sha256 string, at array<int>, times array<int>, pair array<long>, n array<long>"
ALIGNED = f"{DOCUMENT}, n_best long, count_sum long, groups_sha256 string"


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself where it is printable, else the next one from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoders:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_level_alphabet()
        words = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            known = all(c in alphabet for c in word)
            self.bytes_a[i] = bytes(alphabet[c] for c in word) if known else word.encode()
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.b.id_to_piece(i)) for i in range(len(self.b)))
        ]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A of a space and the text, and by B of the text."""
        a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [e.ids for e in a], self.b.encode(texts, num_threads=1)


def parts(text: str, limit: int = PART) -> list[str]:
    """The text cut at blanks that no token crosses; the blanks themselves are left out."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = _CUT.search(text, at + limit)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


@dataclass
class Tokens:
    """Ids of several documents by one tokenizer: document i has first[i] to first[i + 1] - 1."""

    ids: np.ndarray
    first: np.ndarray

    def ends(self, sizes: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Byte offset of each token's end, counted on through the documents; base is where each begins."""
        total = np.cumsum(sizes[self.ids])
        before = np.concatenate([[0], total])[self.first[:-1]]
        return total + np.repeat(base - before, np.diff(self.first))

    def without(self, dropped: np.ndarray) -> Tokens:
        """The dropped documents are left without tokens."""
        size = np.diff(self.first)
        kept = np.where(dropped, 0, size)
        return Tokens(self.ids[np.repeat(~dropped, size)], np.concatenate([[0], np.cumsum(kept)]))


def galloped(keys: np.ndarray, ends: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """The first place in ends that is not below each key; every key has one.

    From the guess, steps double until they pass the key; between the last two places a binary
    search decides.
    """
    low = guess.copy()
    high = guess.copy()
    step = 1
    right = np.flatnonzero(ends[guess] < keys)
    while len(right):
        low[right] = high[right] + 1
        high[right] = np.minimum(high[right] + step, len(ends) - 1)
        right = right[ends[high[right]] < keys[right]]
        step *= 2
    step = 1
    left = np.flatnonzero((ends[guess] >= keys) & (guess > 0))
    while len(left):
        low[left] = np.maximum(high[left] - step, 0)
        below = ends[low[left]] < keys[left]
        done = left[below]
        low[done] += 1
        left = left[~below]
        high[left] = low[left]
        left = left[low[left] > 0]
        step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        below = ends[middle] < keys[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
        open_ = open_[low[open_] < high[open_]]
    return low


@dataclass
class Alignment:
    """Links and common ends of several documents, as places in the documents' tokens."""

    link_a: np.ndarray
    link_b: np.ndarray
    common_a: np.ndarray
    common_b: np.ndarray


def _driven(keys, first_short, ends, first_long, chosen) -> tuple[np.ndarray, ...]:
    """Links and common ends of the chosen documents, whose shorter list has the ends keys."""
    n_short, n_long = np.diff(first_short)[chosen], np.diff(first_long)[chosen]
    total = int(n_short.sum())
    if not total:
        return (np.zeros(0, dtype=np.int64),) * 4
    rank = np.arange(total) - np.repeat(np.cumsum(n_short) - n_short, n_short)
    place = rank + np.repeat(first_short[:-1][chosen], n_short)
    begins = np.repeat(first_long[:-1][chosen], n_short)
    guess = begins + rank * np.repeat(n_long, n_short) // np.repeat(n_short, n_short)
    at = galloped(keys[place], ends, guess)
    common = ends[at] == keys[place]
    # The token overlaps from where its predecessor's end stands, or from the next token if both end there.
    since = np.where(rank == 0, begins, np.concatenate([[0], at[:-1] + common[:-1]]))
    width = at - since + 1
    of = np.repeat(np.arange(total), width)
    link_long = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width) + since[of]
    return place[of], link_long, place[common], at[common]


def align(ends_a: np.ndarray, first_a: np.ndarray, ends_b: np.ndarray, first_b: np.ndarray) -> Alignment:
    """All links and common ends; the ends of both lists grow on from document to document."""
    a_drives = np.diff(first_a) <= np.diff(first_b)
    la, lb, ca, cb = _driven(ends_a, first_a, ends_b, first_b, a_drives)
    mb, ma, db, da = _driven(ends_b, first_b, ends_a, first_a, ~a_drives)
    common_a, common_b = np.concatenate([ca, da]), np.concatenate([cb, db])
    order = np.argsort(common_a, kind="stable")
    return Alignment(np.concatenate([la, ma]), np.concatenate([lb, mb]), common_a[order], common_b[order])


class Decimals:
    """The decimal digits of the numbers below n, one row of bytes each with room for a separator."""

    def __init__(self, n: int):
        words = [str(i).encode() for i in range(n)]
        width = len(words[-1]) + 1
        self.text = np.frombuffer(b"".join(w.ljust(width) for w in words), dtype=np.uint8).reshape(n, width)
        self.size = np.array([len(w) for w in words])


def group_texts(a: Tokens, b: Tokens, aligned: Alignment, table: Decimals) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the documents' groups as ``a1,a2|b1;a3|b2,b3``, each document closed by ``;``, and where they start."""
    ends_a, ends_b = aligned.common_a + 1, aligned.common_b + 1
    size_a, size_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    group_a = np.repeat(np.arange(len(size_a)), size_a)
    group_b = np.repeat(np.arange(len(size_b)), size_b)
    total = len(a.ids) + len(b.ids)
    ids = np.empty(total, dtype=np.int64)
    ids[np.arange(len(a.ids)) + (ends_b - size_b)[group_a]] = a.ids
    ids[np.arange(len(b.ids)) + ends_a[group_b]] = b.ids
    after = np.full(total, ord(","), dtype=np.uint8)
    after[ends_a + ends_b - size_b - 1] = ord("|")
    after[ends_a + ends_b - 1] = ord(";")
    rows = table.text[ids]
    size = table.size[ids]
    rows[np.arange(total), size] = after
    out = rows[np.arange(rows.shape[1]) <= size[:, None]]
    stop = np.cumsum(size + 1)
    return out, np.concatenate([[0], stop])[a.first + b.first]


class Memo:
    """Ids of the words met so far; a word is what stands between two blanks at which no token begins before it.

    Forgets everything when it holds more than WORDS words.
    """

    def __init__(self, encoders: Encoders):
        self.encoders = encoders
        self.sizes = [np.array([len(x) for x in t]) for t in (encoders.bytes_a, encoders.bytes_b)]
        self.decimals = Decimals(max(map(len, self.sizes)))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.whole = np.zeros(0, dtype=bool)
        self.ids = [np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)]
        self.first = [np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)]

    def learn(self, words: list[str]) -> None:
        if len(self.number) > WORDS:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        # Words with white space at an end stand alone; the others are encoded side by side.
        inner, edge = [], []
        for w in new:
            (edge if w[0].isspace() or w[-1].isspace() else inner).append(w)
        lots = [inner[i : i + LOT] for i in range(0, len(inner), LOT)] + [[w] for w in edge]
        for lot in lots:
            if not self._learn(lot):
                for w in lot:
                    self._learn([w], final=True)

    def _learn(self, lot: list[str], final: bool = False) -> bool:
        """Adds words that are encoded as one text; False if a tokenizer does not give that text back."""
        text = " ".join(lot)
        whole = b" " + text.encode()
        (ids_a,), (ids_b,) = self.encoders.encode([text])
        good = whole == b"".join(map(self.encoders.bytes_a.__getitem__, ids_a)) and (
            whole == b"".join(map(self.encoders.bytes_b.__getitem__, ids_b))
        )
        if not good and not final and len(lot) > 1:
            return False
        ends = np.cumsum([len(w.encode()) + 1 for w in lot])
        for side, ids in enumerate((ids_a, ids_b)):
            ids = np.array(ids if good else [], dtype=np.int32)
            stops = np.searchsorted(np.cumsum(self.sizes[side][ids]), ends) + 1 if good else np.zeros(1, dtype=np.int64)
            self.first[side] = np.concatenate([self.first[side], self.first[side][-1] + stops])
            self.ids[side] = np.concatenate([self.ids[side], ids])
        self.whole = np.concatenate([self.whole, np.full(len(lot), good)])
        self.number.update(zip(lot, range(len(self.number), len(self.number) + len(lot)), strict=True))
        return True

    def tokens(self, numbers: np.ndarray, first_word: np.ndarray, side: int) -> Tokens:
        """The ids of texts that are made of the words with these numbers."""
        begin, size = self.first[side][numbers], np.diff(self.first[side])[numbers]
        stop = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(int(stop[-1])) + np.repeat(begin - stop[:-1], size)
        return Tokens(self.ids[side][place].astype(np.int64), stop[first_word])


@cache
def memo_of(path_a: str, path_b: str) -> Memo:
    """One memory for all tasks of a Python worker."""
    return Memo(Encoders(path_a, path_b))


def split_words(text: str) -> list[str]:
    """The text cut at single blanks between characters that are no white space."""
    return _CUT.split(text) if text[0] == " " or text[-1] == " " or _ODD.search(text) else text.split(" ")


class Chunk:
    """Documents of one chunk: their rows, and the pairs they hold."""

    def __init__(self, memo: Memo):
        self.memo = memo
        self.sizes = memo.sizes
        self.radix = len(memo.encoders.bytes_b)
        if len(memo.encoders.bytes_a) * self.radix > 1 << 32:
            raise ValueError("more than 2**32 pairs of ids")
        self.bytes = 0
        self.doc_ids: list[int | None] = []
        self.digests: list = []
        self.counts: list[np.ndarray] = []
        self.refused: set[int] = set()
        self.waiting: list[tuple[int, str]] = []
        self.waiting_size = 0
        self.doc: list[np.ndarray] = []
        self.pair: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: str) -> None:
        number = len(self.doc_ids)
        self.doc_ids.append(doc_id)
        self.digests.append(None)
        for part in parts(text) if text else ():
            self.waiting.append((number, part))
            self.waiting_size += len(part)
            if self.waiting_size >= BATCH:
                self.flush()
        self.bytes += len(text)

    def flush(self) -> None:
        """Aligns the waiting parts. Both tokenizers end a token where a part ends, so parts are aligned alone."""
        if not self.waiting:
            return
        owner = np.array([n for n, _ in self.waiting])
        cut = [split_words(part) for _, part in self.waiting]
        self.waiting, self.waiting_size = [], 0
        words = [w for c in cut for w in c]
        memo = self.memo
        memo.learn(words)
        numbers = np.fromiter(map(memo.number.__getitem__, words), dtype=np.int64, count=len(words))
        first_word = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
        damaged = np.add.reduceat(~memo.whole[numbers], first_word[:-1], dtype=np.int64) > 0
        self.refused.update(owner[damaged].tolist())
        a, b = (memo.tokens(numbers, first_word, side) for side in (0, 1))
        # Where a part is damaged its tokens need not end together: its document has none.
        if damaged.any():
            a, b = a.without(damaged), b.without(damaged)
        total = np.concatenate([[0], np.cumsum(self.sizes[0][a.ids])])[a.first]
        aligned = align(a.ends(self.sizes[0], total[:-1]), a.first, b.ends(self.sizes[1], total[:-1]), b.first)
        joined, start = group_texts(a, b, aligned, memo.decimals)
        view = memoryview(joined)
        for n, s, e in zip(owner.tolist(), start[:-1].tolist(), start[1:].tolist(), strict=True):
            if self.digests[n] is None:
                self.digests[n] = hashlib.sha256(view[s : max(e - 1, s)])
            else:
                self.digests[n].update(b";" + bytes(view[s : max(e - 1, s)]))
        part_of_a = np.repeat(np.arange(len(owner)), np.diff(a.first))
        part_of_link = part_of_a[aligned.link_a]
        pair = a.ids[aligned.link_a] * self.radix + b.ids[aligned.link_b]
        keys, times = np.unique((owner[part_of_link] << 32) | pair, return_counts=True)
        self.doc.append(keys >> 32)
        self.pair.append(keys & 0xFFFFFFFF)
        self.times.append(times)
        n = len(owner)
        groups = np.bincount(part_of_a[aligned.common_a], minlength=n)
        links = np.bincount(part_of_link, minlength=n)
        self.counts.append(np.stack([owner, np.diff(a.first), np.diff(b.first), groups, links]))

    def rows(self) -> dict[str, pa.Array]:
        n = len(self.doc_ids)
        counts = np.zeros((4, n), dtype=np.int64)
        for owner, *more in self.counts:
            for column, values in zip(counts, more, strict=True):
                np.add.at(column, owner, values)
        refused = sorted(self.refused)
        counts[:, refused] = 0
        digests = [d.hexdigest() if d is not None else "" for d in self.digests]
        for i in refused:
            digests[i] = ""
        named = dict(zip(("n_a", "n_b", "n_groups", "n_links"), map(pa.array, counts), strict=True))
        return {"doc_id": pa.array(self.doc_ids, pa.int64()), "groups_sha256": pa.array(digests, pa.string())} | named

    def batches(self, number: int) -> Iterator[pa.RecordBatch]:
        """A row for each document and one for the chunk; frequent pairs have small numbers."""
        self.flush()
        none = [np.zeros(0, dtype=np.int64)]
        doc, pair, times = (np.concatenate(none + x) for x in (self.doc, self.pair, self.times))
        if self.refused:
            keep = ~np.isin(doc, list(self.refused))
            doc, pair, times = doc[keep], pair[keep], times[keep]
        # A document whose parts fell into two batches holds a pair twice; its entries still stand together.
        pairs, at = np.unique(pair, return_inverse=True)
        counts = np.bincount(at, weights=times, minlength=len(pairs)).astype(np.int64)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(pairs), dtype=np.int32)
        rank[order] = np.arange(len(pairs))
        per_doc = np.bincount(doc, minlength=len(self.doc_ids))
        offsets = pa.array(np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32))
        columns = self.rows() | {
            "at": pa.ListArray.from_arrays(offsets, pa.array(rank[at])),
            "times": pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
        }
        yield _encoded(number, len(self.doc_ids), columns)
        yield _encoded(number, 1, {"pair": pa.array([pairs[order]]), "n": pa.array([counts[order]])})


_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64())]
    + [("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
    + [("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
    + [("pair", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]
)


def _encoded(number: int, rows: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    columns["chunk"] = pa.array(np.full(rows, number))
    return pa.record_batch(
        [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _SCHEMA],
        schema=_SCHEMA,
    )


@dataclass(frozen=True)
class CrossTokenizer:
    """Aligns tokenizer files path_a and path_b; chunk_bytes bounds what one task handles at a time."""

    path_a: str
    path_b: str
    chunk_bytes: int = 1 << 22

    def encoded(self, documents: DataFrame) -> DataFrame:
        """Rows of documents, and of chunks, as ENCODED names them; chunk numbers hold for one run only."""
        path_a, path_b, limit = self.path_a, self.path_b, self.chunk_bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = memo_of(path_a, path_b)
            number = TaskContext.get().partitionId() << 32
            chunk = Chunk(memo)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                for row in range(batch.num_rows):
                    chunk.add(ids[row].as_py(), texts[row].as_py() or "")
                    if chunk.bytes >= limit:
                        yield from chunk.batches(number)
                        number, chunk = number + 1, Chunk(memo)
            if chunk.doc_ids:
                yield from chunk.batches(number)

        return documents.select("doc_id", "text").mapInArrow(run, ENCODED)

    def align(self, documents: DataFrame) -> DataFrame:
        """One row per document, as ALIGNED names them."""
        encoded = stored(self.encoded(documents), "cross-tokenizer")
        radix = _ids_of_b(self.path_b)
        held = encoded.filter(F.col("pair").isNotNull()).select(
            "chunk", F.posexplode(F.arrays_zip("pair", "n")).alias("at", "held")
        ).select("chunk", "at", "held.pair", "held.n")
        totals = stored(held.groupBy("pair").agg(F.sum("n").alias("total")), "cross-tokenizer-totals")
        b = F.pmod("pair", F.lit(radix)).alias("b")
        highest = totals.groupBy(b).agg(F.max("total").alias("highest"))
        marked = totals.withColumn("b", b).join(highest, "b").select(
            "pair", "total", (F.col("total") == F.col("highest")).alias("best")
        )
        looked_up = held.join(marked, "pair").select(F.col("chunk").alias("of"), "at", "total", "best")
        rows = encoded.filter(F.col("pair").isNull()).drop("pair", "n")
        return rows.groupBy("chunk").cogroup(looked_up.groupBy("of")).applyInArrow(_scored, ALIGNED)


def _ids_of_b(path: str) -> int:
    import sentencepiece

    return len(sentencepiece.SentencePieceProcessor(model_file=path))


def _scored(rows: pa.Table, looked_up: pa.Table) -> pa.Table:
    """The documents of one chunk with the totals of their pairs."""
    at = looked_up["at"].to_numpy()
    total = np.zeros(len(at), dtype=np.int64)
    best = np.zeros(len(at), dtype=np.int64)
    total[at] = looked_up["total"].to_numpy()
    best[at] = looked_up["best"].to_numpy()
    rows = rows.combine_chunks()
    per_doc = np.diff(rows["at"].combine_chunks().offsets.to_numpy())
    places = rows["at"].combine_chunks().flatten().to_numpy()
    times = rows["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
    stops = np.concatenate([[0], np.cumsum(per_doc)])

    def summed(values: np.ndarray) -> pa.Array:
        sums = np.concatenate([[0], np.cumsum(values)])
        return pa.array(sums[stops[1:]] - sums[stops[:-1]])

    kept = [rows[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    n_best, count_sum = summed(times * best[places]), summed(times * total[places])
    return pa.table(
        [*kept, n_best, count_sum, rows["groups_sha256"]],
        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    )
