"""Quality by a weak-label model.

Overlapping heuristic labellers vote junk, clean or nothing on every document. Expectation
maximisation over the counts of vote patterns of all documents estimates how often each
labeller is right and how common junk is. The posterior of each pattern labels documents,
and those labels train a linear scorer over hashed features, which scores every text.
No given label is used.

Defined results: null and empty texts get no votes and the features of an empty text; they
are rejected. Every row gets its own score; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from resolver_audit.llm.storage import stored
from resolver_audit.llm.words import VISIBLE, Words, binary_parts, chunks, mix, split_words

JUNK, CLEAN, NOTHING = 1, 0, -1

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"%$&*#@^~=<>{}[]\\_+")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_BAR = np.zeros(256, dtype=bool)
_BAR[list(b"|\t")] = True
_BANG = np.zeros(256, dtype=bool)
_BANG[list(b"!?")] = True
_DOT = np.zeros(256, dtype=bool)
_DOT[list(b".,;:")] = True

#: Measures of a text; each is a share between 0 and 1.
MEASURES = ("symbols", "upper", "bars", "bangs", "repeats", "variety", "tied", "letters", "stops")

#: A labeller votes junk on one side of a bound, clean on the other side of the second.
LABELLERS = (
    ("symbols", 0.05, 0.01),
    ("upper", 0.35, 0.12),
    ("bars", 0.05, 0.01),
    ("bangs", 0.10, 0.02),
    ("repeats", 0.30, 0.05),
    ("tied", 0.40, 0.10),
)
#: The same with junk below the first bound.
LOW_LABELLERS = (("variety", 0.15, 0.35), ("letters", 0.60, 0.75), ("stops", 0.004, 0.02))

BUCKETS = 1 << 12


def measures(texts: pa.Array) -> tuple[np.ndarray, Words]:
    """(texts, MEASURES), and the words between white space."""
    offsets, data = binary_parts(texts)
    words = split_words(texts, VISIBLE)
    n = np.maximum(words.counts, 1)

    def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[at[1:]] - sums[at[:-1]]

    length = np.maximum(per_text(VISIBLE[data], offsets), 1)
    letters = per_text(_LETTER[data], offsets)
    h = words.hashes
    same = np.zeros(len(h), dtype=np.int64)
    same[1:] = h[1:] == h[:-1]
    same[words.first[:-1][words.first[:-1] < len(h)]] = 0
    doc = words.doc_of_word()
    variety = np.zeros(len(words.first) - 1)
    if len(h):
        order = np.lexsort((h, doc))
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        # Of the first 200 or so words as many as there are: long texts repeat words by nature.
        variety = np.bincount(doc[order], weights=fresh, minlength=len(variety)) / np.minimum(n, 200)
    odd = np.concatenate([[0], np.cumsum(_SYMBOL[data] | _BANG[data] | _BAR[data])])
    tied = np.bincount(doc, weights=odd[words.end] > odd[words.start], minlength=len(variety))
    columns = (
        per_text(_SYMBOL[data], offsets) / length,
        per_text(_UPPER[data], offsets) / np.maximum(letters, 1),
        per_text(_BAR[data], offsets) / length,
        per_text(_BANG[data], offsets) / length,
        np.bincount(doc, weights=same, minlength=len(variety)) / n,
        np.minimum(variety, 1),
        tied / n,
        letters / length,
        np.minimum(per_text(_DOT[data], offsets) / length, 1),
    )
    return np.stack(columns, axis=1).reshape(-1, len(MEASURES)), words


def votes(m: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """(texts, labellers) of JUNK, CLEAN or NOTHING; texts of under five words get none."""
    out = []
    for name, junk, clean in LABELLERS:
        x = m[:, MEASURES.index(name)]
        out.append(np.where(x >= junk, JUNK, np.where(x <= clean, CLEAN, NOTHING)))
    for name, junk, clean in LOW_LABELLERS:
        x = m[:, MEASURES.index(name)]
        out.append(np.where(x <= junk, JUNK, np.where(x >= clean, CLEAN, NOTHING)))
    result = np.stack(out, axis=1)
    result[n_words < 5] = NOTHING
    return result


def features(m: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features as (text, bucket, value): each measure by its level, and word shapes by share."""
    levels = np.minimum((np.sqrt(np.clip(m, 0, 1)) * 12).astype(np.int64), 11)
    texts = np.repeat(np.arange(len(m)), m.shape[1])
    keys = (levels + 1000 * np.arange(m.shape[1])).ravel()
    values = np.ones(len(keys))
    if len(words.start):
        n = np.maximum(words.counts, 1)
        doc = words.doc_of_word()
        size = np.minimum(words.end - words.start, 15)
        last = words.data[words.end - 1]
        shape = size * 64 + np.where(_LETTER[last], 0, last % 61 + 1)
        pair, count = np.unique(doc * 4096 + shape, return_counts=True)
        texts = np.concatenate([texts, pair // 4096])
        keys = np.concatenate([keys, pair % 4096 + 100_000])
        values = np.concatenate([values, count / n[pair // 4096]])
    return texts, (mix(keys.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64), values


@dataclass(frozen=True)
class LabelModel:
    """prior: share of junk. right: for each labeller, the chance that a vote on junk and on clean is right."""

    prior: float
    right: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of junk for rows of votes; without votes, the prior."""
        junk, clean = np.log(self.prior), np.log(1 - self.prior)
        on_junk, on_clean = self.right[:, 0], self.right[:, 1]
        is_junk, is_clean = patterns == JUNK, patterns == CLEAN
        a = junk + is_junk @ np.log(on_junk) + is_clean @ np.log(1 - on_junk)
        b = clean + is_junk @ np.log(1 - on_clean) + is_clean @ np.log(on_clean)
        return 1 / (1 + np.exp(np.clip(b - a, -50, 50)))


def estimated(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation maximisation over vote patterns and how many documents have each."""
    n_labellers = patterns.shape[1]
    # A labeller knows one kind of junk, so it misses most junk and rarely blames clean text.
    model = LabelModel(0.2, np.tile([0.3, 0.98], (n_labellers, 1)))
    is_junk, is_clean = patterns == JUNK, patterns == CLEAN
    for _ in range(rounds):
        p = model.posterior(patterns)
        a, b = counts * p, counts * (1 - p)
        junk = (a @ is_junk + 1) / (a @ (is_junk | is_clean) + 2)
        clean = (b @ is_clean + 9) / (b @ (is_junk | is_clean) + 10)
        # Bounds keep the two classes from being swapped.
        right = np.stack([np.clip(junk, 0.02, 0.999), np.clip(clean, 0.6, 0.999)], axis=1)
        prior = float(np.clip((a.sum() + 1) / (counts.sum() + 2), 0.001, 0.5))
        moved = abs(prior - model.prior) + np.abs(right - model.right).max()
        model = LabelModel(prior, right)
        if moved < 1e-7:
            break
    return model


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Chance that a text is of good quality."""
        m, words = measures(texts)
        row, bucket, value = features(m, words)
        z = np.bincount(row, weights=self.weights[bucket] * value, minlength=len(m)) + self.bias
        good = 1 / (1 + np.exp(np.clip(z, -30, 30)))
        return np.where(words.counts == 0, 0.0, good)


@dataclass(frozen=True)
class WeakQuality:
    """sample: about so many texts train the scorer at most, chosen by a hash of the text; equal texts
    come once, with their number as weight. All documents count for the label model."""

    sample: int = 20_000
    rounds: int = 150
    decay: float = 1e-4

    def fit(self, documents: DataFrame) -> QualityModel:
        n = len(LABELLERS) + len(LOW_LABELLERS)

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    m, words = measures(part.column("text"))
                    code = (votes(m, words.counts) + 1) @ (3 ** np.arange(n))
                    codes, counts = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["pattern", "n"]
                    )

        # At most 3 ** labellers patterns come to the driver, each with its count.
        rows = (
            documents.select("text")
            .mapInArrow(vote, "pattern long, n long")
            .groupBy("pattern")
            .agg(F.sum("n").alias("n"))
            .collect()
        )
        code = np.array([r["pattern"] for r in rows], dtype=np.int64)
        counts = np.array([r["n"] for r in rows], dtype=float)
        patterns = (code[:, None] // 3 ** np.arange(n)) % 3 - 1
        model = estimated(patterns.reshape(-1, n), counts)
        share = self.sample / max(counts.sum(), 1)
        chosen = documents.select("text")
        if share < 1:
            chosen = chosen.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
        # Copies are counted before anything comes to the driver: a text of a third of all rows is one row.
        chosen = chosen.groupBy(F.xxhash64("text").alias("h")).agg(
            F.first("text").alias("text"), F.count(F.lit(1)).alias("n")
        )

        def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    m, words = measures(part.column("text"))
                    p = model.posterior(votes(m, words.counts))
                    row, bucket, value = features(m, words)
                    order = np.argsort(row, kind="stable")
                    at = np.searchsorted(row[order], np.arange(len(m) + 1))
                    lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x[order])) for x in (bucket, value)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("h"), part.column("n"), pa.array(p), *lists],
                        names=["h", "n", "junk", "bucket", "value"],
                    )

        schema = "h long, n long, junk double, bucket array<long>, value array<double>"
        taught = stored(chosen.mapInArrow(teach, schema), "quality-sample")
        weights, bias = trained(taught, self.rounds, self.decay)
        return QualityModel(model, weights, bias)


def trained(taught: DataFrame, rounds: int, decay: float) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels; the sample is bounded, so one process fits it."""
    table = taught.toArrow().sort_by("h")
    y, n = table["junk"].to_numpy(), table["n"].to_numpy().astype(float)
    if not len(y):
        return np.zeros(BUCKETS), 0.0
    lists = table["bucket"].combine_chunks()
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    bucket, value = lists.flatten().to_numpy(), table["value"].combine_chunks().flatten().to_numpy()
    w, bias = np.zeros(BUCKETS), 0.0
    square_w, square_b = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, weights=w[bucket] * value, minlength=len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * n / n.sum()
        g = np.bincount(bucket, weights=error[row] * value, minlength=BUCKETS) + decay * w
        square_w += g * g
        square_b += error.sum() ** 2
        w -= 0.5 * g / np.sqrt(square_w)
        bias -= 0.5 * error.sum() / np.sqrt(square_b)
    return w, float(bias)


def scored(documents: DataFrame, model: QualityModel, column: str = "quality_score") -> DataFrame:
    """The documents' rows and columns, with the chance of good quality."""
    schema = StructType([f for f in documents.schema if f.name != column] + [StructField(column, DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                values = pa.array(model.scores(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*part.schema.names, column])

    return documents.drop(column).mapInArrow(score, schema)


def kept(documents: DataFrame, model: QualityModel, limit: float = 0.5) -> DataFrame:
    """The documents whose chance of good quality reaches the limit; rows and columns unchanged."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield part.filter(pa.array(model.scores(part.column("text")) >= limit))

    return documents.mapInArrow(keep, documents.schema)
