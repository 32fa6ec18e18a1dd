"""License scans by diagonal voting.

Every rolling k-gram of words of every text is joined, by its hash, to the places where
known license templates hold that k-gram. A match at word p of the text and word t of the
template votes for the diagonal p - t. Votes are summed by diagonal, neighbouring diagonals
(inserted or missing words) are merged, and each span that got enough votes is verified
word by word against the template.

Defined results: null and empty texts, and texts without words, have no words, no places and
score 0. Every row has a row in the result, repeated rows too, and a null doc_id is one like others.
Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resolver_audit.llm.storage import stored
from resolver_audit.llm.words import ALNUM, chunks, grams_within, phrase_hashes, split_words

#: Words of a k-gram; the shortest template has as many.
K = 3

#: Place of the row that every document has, beside those of its k-grams.
HEAD = -1


@dataclass(frozen=True)
class Template:
    """exact: every word must stand there, on one diagonal. Else near matches count too."""

    label: str
    text: str
    exact: bool = False

    @property
    def words(self) -> list[bytes]:
        return split_words(pa.array([self.text]), ALNUM).text_of(0)


#: Phrases whose places are counted.
BASE = (
    Template("mit", "under the mit license", exact=True),
    Template("apache-2", "apache license version 2", exact=True),
    Template("cc-by-nc", "cc by nc", exact=True),
)

#: Longer passages of license texts, which may be changed a little.
LONGER = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


@dataclass(frozen=True)
class LicenseScan:
    """gap: diagonals this near are one span. least_votes: share of a template's k-grams.
    similarity: least share of equal words that a span of a longer template must have."""

    templates: tuple[Template, ...] = BASE + LONGER
    gap: int = 2
    least_votes: float = 0.4
    similarity: float = 0.8

    def positions(self, spark: SparkSession) -> DataFrame:
        """(gram, template, t_pos): the template side of the join, as large as the templates."""
        rows = [
            (gram, i, t)
            for i, template in enumerate(self.templates)
            for t, gram in enumerate(phrase_hashes(template.text, K))
        ]
        return spark.createDataFrame(rows, "gram long, template int, t_pos int")

    def votes(self, documents: DataFrame) -> DataFrame:
        """A row for each matched k-gram, and one at place HEAD for each document."""
        grams = keyed(documents).mapInArrow(_grams, "doc_id long, key long, n_words int, pos int, gram long")
        joined = grams.join(F.broadcast(self.positions(documents.sparkSession)), "gram", "left")
        return joined.filter((F.col("template").isNotNull()) | (F.col("pos") == HEAD)).drop("gram")

    def spans(self, votes: DataFrame) -> DataFrame:
        """(doc_id, key, template, start, stop): spans with enough votes, words start to stop - 1."""
        shapes = [
            (i, len(t.words), 0 if t.exact else self.gap,
             (len(t.words) - K + 1) if t.exact else max(1, round(self.least_votes * (len(t.words) - K + 1))))
            for i, t in enumerate(self.templates)
        ]
        shape = votes.sparkSession.createDataFrame(shapes, "template int, length int, gap int, least int")
        span = ["doc_id", "key", "template"]
        diagonals = (
            votes.filter("template IS NOT NULL")
            .select(*span, "pos", "t_pos")
            .distinct()  # repeated rows vote once
            .groupBy(*span, (F.col("pos") - F.col("t_pos")).alias("diagonal"))
            .agg(F.count(F.lit(1)).alias("votes"))
            .join(F.broadcast(shape), "template")
        )
        order = Window.partitionBy(*span).orderBy("diagonal")
        new = F.col("diagonal") - F.lag("diagonal").over(order) > F.col("gap")
        runs = diagonals.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn(
            "run", F.sum("new").over(order)
        )
        return (
            runs.groupBy(*span, "run", "length", "least")
            .agg(F.min("diagonal").alias("start"), F.max("diagonal").alias("last"), F.sum("votes").alias("votes"))
            .filter("votes >= least")
            .select(*span, "start", (F.col("last") + F.col("length")).alias("stop"))
        )

    def verified(self, documents: DataFrame, spans: DataFrame) -> DataFrame:
        """Adds similarity to the spans that hold word by word.

        Spans of a document are few against its words, so they travel with its text.
        """
        of_doc = spans.groupBy(F.col("doc_id").alias("span_doc"), F.col("key").alias("span_key")).agg(
            F.collect_list(F.struct("template", "start", "stop")).alias("spans")
        )
        same = F.col("key").eqNullSafe(F.col("span_key")) & F.col("doc_id").eqNullSafe(F.col("span_doc"))
        found = keyed(documents).join(of_doc, same).select("doc_id", "key", "text", "spans")
        checks = [(t.words, t.exact) for t in self.templates]
        least = self.similarity
        schema = "doc_id long, key long, template int, start int, stop int, similarity double"

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    yield _verified(part, checks, least)

        return found.mapInArrow(verify, schema).distinct()

    def scan(self, documents: DataFrame) -> DataFrame:
        """One row per document: its words, base places, labels and score."""
        votes = stored(self.votes(documents), "license-votes")
        spans = stored(self.spans(votes), "license-spans")
        places = self.verified(documents, spans)
        labels = documents.sparkSession.createDataFrame(
            [(i, t.label, t.exact) for i, t in enumerate(self.templates)], "template int, label string, base boolean"
        )
        base = F.col("base")
        of_doc = (
            places.join(F.broadcast(labels), "template")
            .groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k"))
            .agg(
                F.count(F.when(base, 1)).alias("n_base"),
                F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
                F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
                F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
                F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
                F.max("similarity").alias("score"),
            )
        )
        docs = votes.filter(F.col("pos") == HEAD).select("doc_id", "key", F.col("n_words").cast("long"))
        same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("key").eqNullSafe(F.col("k"))
        return docs.join(of_doc, same, "left").select(
            "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
            "first_word", "last_word",
            F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, key and text; the key tells rows of one doc_id with different texts apart."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text")
    )


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All k-grams of the texts by hash, and for each text a row at place HEAD without one."""
    for batch in batches:
        for part in chunks(batch):
            words = split_words(part.column("text"), ALNUM)
            place, gram = grams_within(words, K)
            owner = words.doc_of_word()[place]
            heads = np.arange(len(words.counts))
            take = pa.array(np.concatenate([owner, heads]))
            n_words = words.counts.astype(np.int32)
            pos = np.concatenate([place - words.first[owner], np.full(len(heads), HEAD)])
            grams = np.concatenate([gram.view(np.int64), np.zeros(len(heads), dtype=np.int64)])
            missing = np.arange(len(grams)) >= len(gram)
            for lo in range(0, len(grams), 1 << 16):
                cut = slice(lo, lo + (1 << 16))
                rows = take.slice(lo, 1 << 16)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(rows),
                        part.column("key").take(rows),
                        pa.array(n_words).take(rows),
                        pa.array(pos[cut].astype(np.int32)),
                        pa.array(grams[cut], mask=missing[cut]),
                    ],
                    names=["doc_id", "key", "n_words", "pos", "gram"],
                )


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            up = row[j]
            row[j] = left + 1 if x == y else max(up, row[j - 1])
            left = up
    return row[-1]


def _verified(part: pa.RecordBatch, checks: list[tuple[list[bytes], bool]], least: float) -> pa.RecordBatch:
    words = split_words(part.column("text"), ALNUM)
    rows: dict[str, list] = {n: [] for n in ("doc_id", "key", "template", "start", "stop", "similarity")}
    ids, keys = part.column("doc_id").to_pylist(), part.column("key").to_pylist()
    for i, spans in enumerate(part.column("spans").to_pylist()):
        first, last = words.first[i], words.first[i + 1]
        for span in spans:
            template, exact = checks[span["template"]]
            lo, hi = first + max(0, span["start"]), min(last, first + span["stop"])
            there = [words.data[s:e].tobytes() for s, e in zip(words.start[lo:hi], words.end[lo:hi], strict=True)]
            same = common_words(template, there) / len(template)
            if (there == template) if exact else same >= least:
                values = (ids[i], keys[i], span["template"], int(lo - first), int(hi - first), same)
                for column, value in zip(rows.values(), values, strict=True):
                    column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows)
    )
