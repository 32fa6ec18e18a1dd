"""Benchmark decontamination with SimHash windows and multi-index Hamming search.

Each benchmark item falls in two classes of window lengths: a long one a little below its own
length, and a short one that fits into the words an accepted near copy leaves unchanged
between its edits. All windows of such a length inside the item are indexed by a 64-bit
SimHash of their words. Documents are read in windows of the same lengths that start at every
word. A fingerprint within the radius of an indexed one agrees with it on at least one of
radius + 1 bit blocks, so looking up every block finds all of them. A found window is laid
over the item at its own offset, and the item-sized passages that start there or up to a
quarter of the item away are verified by weighted Jaccard similarity of five-word shingles.

Windows and passages around which the weights of all shingles known from items fall short of
the similarity are not read: no verification could accept them, so nothing is lost.

Defined results: null and empty texts and items match nothing. An item of fewer than five
words is one shingle. Repeated rows of a document match alike; rows without doc_id keep a
null doc_id. Items that share an item_id are separate texts of that item, and repeated rows
of an item count once. Items of any length are verified whole. Other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resolver_audit.llm.words import ALNUM, Words, chunks, rolling, split_words

SHINGLE = 5
#: Words of the longest window. Neighbouring windows of many more words hardly differ, so that each
#: would be near all others and pairs would grow with the square of a long item.
MOST_WORDS = 600
#: Text read at once: 64 counters for each word are kept.
_CHUNK = 1 << 20


def window_length(n_words: int) -> int:
    """The class of an item: all of it up to 12 words, else a step of a geometric ladder below 0.85 of it.

    Windows have MOST_WORDS words at most; passages are verified at the length of the whole item all the same.
    """
    return n_words if n_words <= 12 else ladder(min(0.85 * n_words, MOST_WORDS))


def ladder(limit: float) -> int:
    """The largest step of the ladder up to the limit, five at least."""
    step = SHINGLE
    while (larger := step * 5 // 4) <= limit:
        step = larger
    return step


def window_lengths(n_words: int) -> set[int]:
    """Both classes of an item. Edits that keep a similarity of 0.8 leave a run of the short one's length untouched."""
    if n_words <= SHINGLE:
        return {n_words}
    return {window_length(n_words), ladder(min(0.45 * n_words, 22))}


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """Running counts of ones for each of 64 bits, modulo 2**16; windows are shorter than that."""
    counts = np.zeros((len(hashes) + 1, 64), dtype=np.uint16)
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
    np.cumsum(bits, axis=0, dtype=np.uint16, out=counts[1:])
    return counts


def simhashes(counts: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of the windows of length words at starts: the majority of each bit."""
    ones = counts[starts + length] - counts[starts]
    return np.packbits(ones > length // 2, axis=1, bitorder="little").view(np.uint64).ravel()


def shingles(hashes: np.ndarray) -> np.ndarray:
    if 0 < len(hashes) < SHINGLE:
        return rolling(hashes, len(hashes))
    return rolling(hashes, SHINGLE)


@dataclass
class Band:
    """Indexed windows of one length. For each bit block: fingerprints ordered by block value.

    longest, lightest: most words and least weight of an item in the class.
    """

    length: int
    longest: int
    lightest: float
    prints: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    blocks: list[tuple[int, int, np.ndarray, np.ndarray]]

    def near(self, found: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, print) numbers of all pairs within the radius; a pair may come from several blocks."""
        windows, prints = [], []
        for shift, width, begin, order in self.blocks:
            value = ((found >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
            count = begin[value + 1] - begin[value]
            hit = np.flatnonzero(count)
            n = count[hit]
            window = np.repeat(hit, n)
            within = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
            candidate = order[begin[value[window]] + within]
            close = np.bitwise_count(found[window] ^ self.prints[candidate]) <= radius
            windows.append(window[close])
            prints.append(candidate[close])
        return np.concatenate(windows), np.concatenate(prints)


@dataclass
class Index:
    """Everything a task needs to know of one block of items."""

    ids: list[int | None]
    lengths: np.ndarray
    sets: list[dict[int, float]]
    weight: dict[int, float]
    unseen: float
    bands: list[Band]
    totals: np.ndarray
    grams: np.ndarray
    gram_weights: np.ndarray
    marked: np.ndarray

    def shared(self, words: Words, size: int) -> np.ndarray:
        """The weight of the shingle of size words that starts at each word; 0 where no item has it."""
        weights = np.zeros(len(words.hashes))
        grams = rolling(words.hashes, size)
        at = np.flatnonzero(self.marked[(grams & np.uint64(len(self.marked) - 1)).astype(np.int64)])
        at = at[at + size <= np.repeat(words.first[1:], words.counts)[at]]
        place = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        same = self.grams[place] == grams[at]
        weights[at[same]] = self.gram_weights[place[same]]
        return weights


def index_of(items: list[tuple[int | None, str | None]], radius: int, total: int) -> Index:
    """total: items of the whole benchmark, for the weights of shingles that none has."""
    words = split_words(pa.array([text for _, text in items], pa.string()), ALNUM)
    hashes = [words.hashes[words.first[i] : words.first[i + 1]] for i in range(len(items))]
    grams = [Counter(shingles(h).tolist()) for h in hashes]
    df = Counter(g for c in grams for g in c)
    weight = {g: 1 + np.log(max(total, len(items)) / n) for g, n in df.items()}
    unseen = 1 + float(np.log(max(total, len(items), 1)))
    sets = [{g: n * weight[g] for g, n in c.items()} for c in grams]
    classes: dict[int, list[int]] = {}
    for i, h in enumerate(hashes):
        if len(h):
            for length in window_lengths(len(h)):
                classes.setdefault(length, []).append(i)
    totals = np.array([sum(own.values()) for own in sets])
    known = np.array(sorted(weight), dtype=np.uint64)
    marked = np.zeros(1 << (16 * len(known)).bit_length(), dtype=bool)
    marked[(known & np.uint64(len(marked) - 1)).astype(np.int64)] = True
    bands = []
    for length, members in sorted(classes.items()):
        prints, item, offset = [], [], []
        for i in members:
            starts = np.arange(len(hashes[i]) - length + 1)
            prints.append(simhashes(bit_counts(hashes[i]), starts, length))
            item.append(np.full(len(starts), i))
            offset.append(starts)
        p = np.concatenate(prints)
        blocks = []
        edges = np.linspace(0, 64, radius + 2).astype(int)
        for lo, hi in zip(edges, edges[1:], strict=False):
            value = ((p >> np.uint64(lo)) & np.uint64((1 << int(hi - lo)) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            begin = np.searchsorted(value[order], np.arange((1 << int(hi - lo)) + 1))
            blocks.append((int(lo), int(hi - lo), begin, order))
        longest, lightest = max(len(hashes[i]) for i in members), float(totals[members].min())
        bands.append(Band(length, longest, lightest, p, np.concatenate(item), np.concatenate(offset), blocks))
    lengths = np.array([len(h) for h in hashes], dtype=np.int64)
    gram_weights = np.array([weight[int(g)] for g in known], dtype=float)
    return Index([i for i, _ in items], lengths, sets, weight, unseen, bands, totals, known, gram_weights, marked)


def similarity(index: Index, item: int, window: np.ndarray) -> float:
    """Weighted Jaccard similarity of an item and a window of words."""
    own = index.sets[item]
    both = own_total = other_total = 0.0
    found = Counter(shingles(window).tolist())
    for gram, n in found.items():
        weight = index.weight.get(gram, index.unseen) * n
        other_total += weight
        both += min(weight, own.get(gram, 0.0))
    own_total = sum(own.values())
    return both / (own_total + other_total - both)


def matches(words: Words, index: Index, radius: int, least: float) -> Iterator[tuple[int, int, int, float]]:
    """(text, item, first word, similarity) of the verified places in the texts.

    Places are verified in the order of the most they can reach; those that cannot come up to the best
    place of the same text and item are left out.
    """
    if not len(words.hashes) or not index.bands:
        return
    sizes = {min(SHINGLE, band.length) for band in index.bands}
    weights = {size: index.shared(words, size) for size in sizes}
    doc = words.doc_of_word()
    live = np.zeros(len(words.first) - 1, dtype=bool)
    for known in weights.values():
        live[doc[known > 0]] = True
    read = live[doc]
    if not read.any():
        return
    # From here on, places count the words of texts with a shingle of some item.
    hashes, doc = words.hashes[read], doc[read]
    n = len(hashes)
    first = np.concatenate([[0], np.cumsum(np.where(live, words.counts, 0))])
    begin, end = first[doc], first[doc + 1]
    mass = {size: np.concatenate([[0], np.cumsum(known[read])]) for size, known in weights.items()}
    strange = {size: np.concatenate([[0], np.cumsum(known[read] == 0)]) for size, known in weights.items()}
    # Sums of the same weights in another order differ by rounding.
    enough = least - 1e-6
    counts = bit_counts(hashes)
    here = np.arange(n)
    tried = set()
    best: dict[tuple[int, int], float] = {}
    for band in index.bands:
        size = min(SHINGLE, band.length)
        known = mass[size]
        lo = np.maximum(here - (band.longest - band.length), begin)
        hi = np.minimum(here + band.longest, end)
        starts = np.flatnonzero((known[hi] - known[lo] >= enough * band.lightest) & (end - here >= band.length))
        if not len(starts):
            continue
        window, found = band.near(simhashes(counts, starts, band.length), radius)
        item, at = band.item[found], starts[window]
        pairs = np.unique(item * n + np.maximum(at - band.offset[found], begin[at]))
        item, at = pairs // n, pairs % n
        # Places up to the reach around each, each place once: they begin behind those of the one before.
        reach = index.lengths[item] // 4
        start, stop = np.maximum(at - reach, begin[at]), np.minimum(at + reach + 1, end[at])
        start[1:] = np.where(item[1:] == item[:-1], np.maximum(start[1:], stop[:-1]), start[1:])
        number = stop - start
        lo = np.arange(number.sum()) + np.repeat(start - np.cumsum(number) + number, number)
        item = np.repeat(item, number)
        hi = np.minimum(lo + index.lengths[item], end[lo])
        # The most similarity that the weights of the passage's shingles allow.
        last = np.maximum(hi - size + 1, lo)
        own, other = index.totals[item], known[last] - known[lo]
        both = np.minimum(own, other)
        other = other + index.unseen * (strange[size][last] - strange[size][lo])
        most = both / (own + other - both)
        heavy = np.flatnonzero(most >= enough)
        heavy = heavy[np.argsort(-most[heavy], kind="stable")]
        columns = (c[heavy].tolist() for c in (item, lo, hi, most))
        for i, a, b, bound in zip(*columns, strict=True):
            pair = (int(doc[a]), i)
            if (i, a) in tried or bound < best.get(pair, 0.0) - 1e-6:
                continue
            tried.add((i, a))
            value = similarity(index, i, hashes[a:b])
            best[pair] = max(best.get(pair, 0.0), value)
            if value >= least:
                yield int(doc[a]), i, a - int(begin[a]), value


@dataclass(frozen=True)
class Decontamination:
    """radius: of the Hamming search. similarity: least weighted Jaccard similarity.
    items: benchmark items that one pass over the documents looks for; more items take more passes."""

    radius: int = 4
    similarity: float = 0.8
    items: int = 20_000

    def _indexes(self, benchmark: DataFrame) -> Iterator[Index]:
        """One index for each bounded block of items; rows that repeat an item and its text count once."""
        source = benchmark.select("item_id", "text").distinct()
        total = source.count()
        blocks = -(-total // self.items)
        for block in range(blocks):
            part = source
            if blocks > 1:
                part = source.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
            yield index_of([(r["item_id"], r["text"]) for r in part.collect()], self.radius, total)

    def matches(self, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
        """doc_id, item_id, first_word, similarity: a row for each document and item it holds, at the best place."""
        radius, least = self.radius, self.similarity
        schema = "doc_id long, item_id long, first_word long, similarity double"
        source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        found = None
        for index in self._indexes(benchmark):
            shared = documents.sparkSession.sparkContext.broadcast(index)

            def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for part in chunks(batch, limit=_CHUNK):
                        ids = part.column("doc_id").to_pylist()
                        words = split_words(part.column("text"), ALNUM)
                        rows = [
                            (ids[text], shared.value.ids[item], first, value)
                            for text, item, first, value in matches(words, shared.value, radius, least)
                        ]
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
                        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "first_word", "similarity"])

            rows = source.mapInArrow(search, schema)
            found = rows if found is None else found.union(rows)
        if found is None:
            return documents.sparkSession.createDataFrame([], schema)
        best = F.max(F.struct("similarity", -F.col("first_word"))).alias("best")
        return found.groupBy("doc_id", "item_id").agg(best).select(
            "doc_id", "item_id", (-F.col("best.col2")).alias("first_word"), F.col("best.similarity").alias("similarity")
        )

    def kept(self, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
        """The documents that hold no item; rows and columns unchanged."""
        radius, least = self.radius, self.similarity
        for index in self._indexes(benchmark):
            shared = documents.sparkSession.sparkContext.broadcast(index)

            def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for part in chunks(batch, limit=_CHUNK):
                        clean = np.ones(part.num_rows, dtype=bool)
                        words = split_words(part.column("text"), ALNUM)
                        for text, *_ in matches(words, shared.value, radius, least):
                            clean[text] = False
                        yield part.filter(pa.array(clean))

            documents = documents.mapInArrow(keep, documents.schema)
        return documents
