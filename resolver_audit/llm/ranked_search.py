"""Ranks all documents for each query item, exactly, by a hybrid of term- and document-at-a-time.

One pass over the documents counts their terms and keeps, for the terms that items hold, how often
each document holds them. The same pass gives the number of documents, of terms, and of documents
for each term. A second job scores shards of documents: a task turns the rows of a shard into lists
by term, sorted by document. For each item

- term at a time, its short lists are summed into accumulators, one for each document;
- document at a time, the accumulators then stand as one more iterator, whose bound is the largest
  sum, beside the long lists with the bounds of their largest entries. While an item's threshold
  (the score of its last place so far) exceeds the bounds of some iterators together, documents
  that only those hold are skipped; a document that is left is looked up in the long lists, largest
  bound first, until the bounds that remain can't lift it to the threshold.

The threshold is carried from shard to shard. A task gives each item's best documents, and a window
ranks these. All scores are whole numbers; skipping spares only documents below the threshold.

Items are taken in blocks by a hash of their number, so that a block's texts have about block_bytes
(a documented bound of what tasks hold of the items); each block is a pass. Terms are told apart by
64-bit hashes.

Defined results: a null or empty text has no term, as a document or as an item. Rows of one item_id
are one item with the terms of all of them; a null item_id is an item too. Each row of documents is
a document, also repeated rows, which have equal places one after the other; a document without
doc_id counts in the statistics but has no name to be ranked by. Other columns play no part. Empty
tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resolver_audit.llm.storage import stored
from resolver_audit.llm.words import ALNUM, chunks, split_words

#: A list is short when it names at most one in SHORT documents of a shard.
SHORT = 8
#: Documents of a shard, and candidates that are scored before the threshold is read again.
SHARD = 1 << 13
BLOCK = 1 << 11

POSTINGS = "doc_id long, n long, term array<int>, tf array<int>, docs long"
RANKED = "item_id long, doc_id long, score long"


@dataclass
class Items:
    """The items of a block: item i holds the terms first[i] to first[i + 1] - 1 of term."""

    ids: list[int | None]
    first: np.ndarray
    term: np.ndarray
    hashes: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Items:
        """From distinct rows (item_id, hash)."""
        ids, at = table["item_id"].combine_chunks(), table["hash"].to_numpy()
        encoded = ids.dictionary_encode(null_encoding="encode")
        number = encoded.indices.to_numpy()
        hashes, term = np.unique(at, return_inverse=True)
        order = np.lexsort((term, number))
        counts = np.bincount(number, minlength=len(encoded.dictionary))
        return Items(
            encoded.dictionary.to_pylist(), np.concatenate([[0], np.cumsum(counts)]), term[order].astype(np.int32), hashes
        )


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct ``item_id, hash`` of the terms of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = split_words(part.column(1), ALNUM)
                rows = pa.array(words.doc_of_word())
                hashes = pa.array(words.hashes.view(np.int64))
                yield pa.record_batch([part.column(0).take(rows), hashes], ["item_id", "hash"])

    chosen = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return chosen.mapInArrow(run, "item_id long, hash long").distinct()


def postings(documents: DataFrame, hashes: np.ndarray) -> DataFrame:
    """Per document its number of terms and how often it holds each of the items' terms.

    Rows with ``docs`` are statistics of some documents: their number, their terms, and documents
    by term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding = np.zeros(len(hashes), dtype=np.int64)
        n_docs = n_words = 0
        for batch in batches:
            for part in chunks(batch):
                words = split_words(part.column(1), ALNUM)
                n = words.counts
                n_docs, n_words = n_docs + int((n > 0).sum()), n_words + int(n.sum())
                found = words.hashes.view(np.int64)
                at = np.minimum(np.searchsorted(hashes, found), max(len(hashes) - 1, 0))
                known = hashes[at] == found if len(hashes) else np.zeros(len(found), dtype=bool)
                held, tf = np.unique(
                    words.doc_of_word()[known] * len(hashes) + at[known], return_counts=True
                )
                doc, term = np.divmod(held, max(len(hashes), 1))
                holding += np.bincount(term, minlength=len(hashes))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))]).astype(np.int32)
                rows = pa.record_batch(
                    [
                        part.column(0),
                        pa.array(n),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(term.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(tf.astype(np.int32))),
                        pa.nulls(len(n), pa.int64()),
                    ],
                    ["doc_id", "n", "term", "tf", "docs"],
                )
                named = np.diff(offsets) > 0
                if rows.column(0).null_count:
                    named &= ~rows.column(0).is_null().to_numpy(zero_copy_only=False)
                yield rows.filter(pa.array(named))
        some = np.flatnonzero(holding)
        lists = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (some, holding[some])]
        yield pa.record_batch(
            [pa.nulls(1, pa.int64()), pa.array([n_words]), *lists, pa.array([n_docs])],
            ["doc_id", "n", "term", "tf", "docs"],
        )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, POSTINGS)


@dataclass
class Weights:
    """What scoring needs of all documents: their number, their terms, and a weight for each term."""

    docs: int
    words: int
    weight: np.ndarray

    @staticmethod
    def of(rows: DataFrame, n_terms: int) -> Weights:
        """From stored postings; the driver gets one number for each term of the block."""
        statistics = rows.filter(F.col("docs").isNotNull())
        docs, words = statistics.agg(F.sum("docs"), F.sum("n")).first()
        by_term = statistics.select(F.explode(F.arrays_zip("term", "tf")).alias("x")).groupBy("x.term")
        counted = by_term.agg(F.sum("x.tf").alias("df")).toArrow()
        df = np.zeros(n_terms, dtype=np.int64)
        df[counted["term"].to_numpy()] = counted["df"].to_numpy()
        weight = [math.floor(1000 * math.log((2 * (docs or 0) + 2) / (2 * d + 1))) for d in df.tolist()]
        return Weights(docs or 0, words or 0, np.array(weight, dtype=np.int64))

    def impacts(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What a term that a document of n terms holds tf times adds to a score, before its weight."""
        fits = 50 * int(n.max(initial=0)) * self.docs < 1 << 63
        length = 50 * n * self.docs if fits else 50 * n.astype(object) * self.docs
        m = 50 + (length // self.words).astype(np.int64)
        return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Shard:
    """Some documents as lists by term."""

    def __init__(self, rows: pa.Table, weights: Weights):
        rows = rows.sort_by("doc_id").combine_chunks()
        self.doc_ids = rows["doc_id"].to_numpy()
        lists = rows["term"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        doc = np.repeat(np.arange(len(size)), size)
        term = lists.flatten().to_numpy()
        tf = rows["tf"].combine_chunks().flatten().to_numpy().astype(np.int64)
        impact = weights.impacts(np.repeat(rows["n"].to_numpy(), size), tf)
        order = np.argsort(term, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        terms, self.first = np.unique(term[order], return_index=True)
        self.size = np.diff(np.append(self.first, len(doc)))
        self.list_of = np.full(len(weights.weight), -1)
        self.list_of[terms] = np.arange(len(terms))
        self.bound = np.maximum.reduceat(self.impact, self.first) * weights.weight[terms]
        self.weight = weights.weight[terms]
        self.sums = np.zeros(len(self.doc_ids), dtype=np.int64)

    def entries(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.first[number], self.first[number] + self.size[number])
        return self.doc[part], self.impact[part] * self.weight[number]


@dataclass
class Best:
    """The best documents of an item so far; ``least`` is what a further one must reach."""

    k: int
    doc_ids: np.ndarray
    scores: np.ndarray

    @property
    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, doc_ids: np.ndarray, scores: np.ndarray) -> None:
        doc_ids, scores = np.concatenate([self.doc_ids, doc_ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((doc_ids, -scores))[: self.k]
        self.doc_ids, self.scores = doc_ids[order], scores[order]


class Searcher:
    """Searches shard after shard for the items of a block. ``looked_up`` counts documents taken to the long lists."""

    def __init__(self, items: Items, k: int):
        self.items = items
        none = np.zeros(0, dtype=np.int64)
        self.best = [Best(k, none, none) for _ in items.ids]
        self.looked_up = 0

    def search(self, shard: Shard) -> None:
        lists = shard.list_of[self.items.term]
        bound = np.concatenate([[0], np.cumsum(np.where(lists >= 0, shard.bound[lists], 0))])
        reach = bound[self.items.first[1:]] - bound[self.items.first[:-1]]
        for i, best in enumerate(self.best):
            if reach[i] >= best.least:
                mine = lists[self.items.first[i] : self.items.first[i + 1]]
                self.one(shard, mine[(mine >= 0)], best)

    def one(self, shard: Shard, mine: np.ndarray, best: Best) -> None:
        mine = mine[shard.bound[mine] > 0]
        is_short = shard.size[mine] * SHORT <= len(shard.doc_ids)
        sums = shard.sums
        touched = []
        for number in mine[is_short].tolist():
            doc, score = shard.entries(number)
            sums[doc] += score
            touched.append(doc)
        # Long lists by falling bound; after[j] is what the lists from j on can add.
        long = mine[~is_short]
        long = long[np.argsort(-shard.bound[long], kind="stable")]
        after = np.append(np.cumsum(shard.bound[long][::-1])[::-1], 0)
        for candidates in self.candidates(shard, long, after, touched, best.least):
            for lo in range(0, len(candidates), BLOCK):
                self.look_up(shard, long, after, candidates[lo : lo + BLOCK], best)
        for doc in touched:
            sums[doc] = 0

    @staticmethod
    def candidates(shard, long, after, touched, least) -> Iterator[np.ndarray]:
        """Documents whose iterators' bounds reach the threshold together, ascending.

        First those of the accumulators. The others are only in long lists: those that can't reach
        the threshold by the lists from j on must be in one of the first j lists.
        """
        if touched:
            found = np.flatnonzero(shard.sums)
            yield found[shard.sums[found] + after[0] >= least]
        if after[0] >= least:
            needed = int(np.count_nonzero(after[:-1] >= least))
            seen = np.zeros(len(shard.doc_ids), dtype=bool)
            for number in long[:needed].tolist():
                seen[shard.entries(number)[0]] = True
            yield np.flatnonzero(seen & (shard.sums == 0))

    def look_up(self, shard: Shard, long, after, candidates: np.ndarray, best: Best) -> None:
        least = best.least
        scores = shard.sums[candidates]
        for j, number in enumerate(long.tolist()):
            keep = scores + after[j] >= least
            if not keep.all():
                candidates, scores = candidates[keep], scores[keep]
            if not len(candidates):
                return
            if not j:
                self.looked_up += len(candidates)
            doc, score = shard.entries(number)
            at = np.minimum(np.searchsorted(doc, candidates), len(doc) - 1)
            scores = scores + np.where(doc[at] == candidates, score[at], 0)
        keep = scores >= least
        if keep.any():
            best.add(shard.doc_ids[candidates[keep]], scores[keep])

    def results(self) -> pa.RecordBatch:
        sizes = [len(b.scores) for b in self.best]
        rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        none = [np.zeros(0, dtype=np.int64)]
        columns = [np.concatenate(none + [getattr(b, c) for b in self.best]) for c in ("doc_ids", "scores")]
        return pa.record_batch(
            [pa.array(self.items.ids, pa.int64()).take(rows), *map(pa.array, columns)], ["item_id", "doc_id", "score"]
        )


@dataclass(frozen=True)
class RankedSearch:
    """The k best documents of each item."""

    k: int = 50
    block_bytes: int = 1 << 22

    def search(self, documents: DataFrame, items: DataFrame) -> DataFrame:
        """``item_id, rank, doc_id, score``; the rank counts from 1."""
        size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = max(1, -(-size // self.block_bytes))
        block = F.pmod(F.xxhash64(F.lit("block"), F.col("item_id").cast("long")), F.lit(blocks))
        found = None
        for number in range(blocks):
            part = self._ranked(documents, items.filter(block == number))
            found = part if found is None else found.unionByName(part)
        return found

    def _ranked(self, documents: DataFrame, items: DataFrame) -> DataFrame:
        held = Items.of(item_terms(items).toArrow())
        rows = stored(postings(documents, held.hashes), "ranked-search")
        weights = Weights.of(rows, len(held.hashes))
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(held, k)
            waiting, n = [], 0
            for batch in batches:
                for row in range(0, batch.num_rows, SHARD):
                    waiting.append(batch.slice(row, SHARD))
                    n += waiting[-1].num_rows
                    if n >= SHARD:
                        searcher.search(Shard(pa.Table.from_batches(waiting), weights))
                        waiting, n = [], 0
            if n:
                searcher.search(Shard(pa.Table.from_batches(waiting), weights))
            yield searcher.results()

        per_task = rows.filter(F.col("docs").isNull()).drop("docs").mapInArrow(run, RANKED)
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
        ranked = per_task.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return ranked.select("item_id", "rank", "doc_id", "score")
