"""Toxicity by a weighted finite-state pattern grammar.

A clause is read word by word. A lexical transducer turns words into classes (insult,
threat, target, negation, report). Three transducers are composed over the classes: negation
marks insults and threats that stand within its scope, reported speech marks those after a
verb of saying, and the target transducer marks those aimed at somebody. The composed machine
emits one pattern for each insult or threat, and each pattern has a weight; a document's
score is the logistic of the weighted patterns of its matched clauses.

Seed words are fixed; more insults and all weights are learned from labelled documents. Words
and beginnings of words are weighed by the smoothed log-odds of their contexts in toxic
documents against clean ones, and count as learned insults when these are high and surely so; inflected
forms that are rare each are learned by their beginning. Learned ones are a class of their own,
with their own weights, so that they do not weaken the seeds'. Contexts are counted once, so copies
of one text teach nothing.

Defined results: null and empty texts, and texts without a match, get the score of the bias.
Every row gets a score by its own text; doc_id and other columns have no part in it. Without
labels the starting weights hold. A column named as the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from resolver_audit.llm.storage import stored
from resolver_audit.llm.words import ALNUM, Words, chunks, mix, split_words

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, LEARNED = range(7)

#: Seed words of the classes.
LEXICON = {
    INSULT: "idiot idiots moron morons stupid scum trash worthless pathetic disgusting loser clown imbecile "
    "idiota estúpido estúpida imbécil basura escoria idiote imbécile ordure minable crétin dummkopf abschaum trottel",
    THREAT: "kill hurt destroy beat stab shoot strangle matar töten tuer",
    TARGET: "you your yours u they them he she him her du dich ihr sie tu te vous él ella ellos usted ustedes",
    NEGATION: "not never no isn aren wasn don nicht kein keine nie pas jamais ne nunca jamás",
    REPORT: "said says say wrote writes claimed claims quoted called sagte schrieb dijo escribió disait écrit",
}

#: Characters of the beginnings of words that are learned.
STEMS = range(3, 9)

#: Bytes that end a clause.
_CLAUSE_END = np.zeros(256, dtype=bool)
_CLAUSE_END[list(b".!?;\n")] = True


@dataclass(frozen=True)
class Transducer:
    """Deterministic; arcs maps (state, symbol) to (output, next state). Absent: the symbol itself, same state."""

    n_states: int
    arcs: dict[tuple[int, str], tuple[str, int]]

    def step(self, state: int, symbol: str) -> tuple[str, int]:
        return self.arcs.get((state, symbol), (symbol, state))


def compose(first: Transducer, then: Transducer, symbols: list[str]) -> Transducer:
    """The machine that feeds what the first one emits to the second."""
    arcs = {}
    for a, b in product(range(first.n_states), range(then.n_states)):
        for symbol in symbols:
            out, a2 = first.step(a, symbol)
            out, b2 = then.step(b, out)
            arcs[a * then.n_states + b, symbol] = (out, a2 * then.n_states + b2)
    return Transducer(first.n_states * then.n_states, arcs)


SYMBOLS = ["other", "insult", "threat", "target", "negation", "report", "learned"]
PATTERNS = [f"{mark}{what}" for what in ("insult", "threat", "learned") for mark in ("", "aimed ", "negated ", "reported ")]


def within(trigger: str, reach: int, mark: str) -> Transducer:
    """Marks unmarked insults and threats at most reach words after the trigger."""
    arcs: dict[tuple[int, str], tuple[str, int]] = {}
    for left in range(reach + 1):
        for symbol in (*SYMBOLS, *PATTERNS):
            out = f"{mark} {symbol}" if left and symbol in ("insult", "threat", "learned") else symbol
            arcs[left, symbol] = (out, reach if symbol == trigger else max(0, left - 1))
    return Transducer(reach + 1, arcs)


def grammar() -> Transducer:
    """Negation, then reported speech, then target; the first mark stays."""
    negation, report, target = within("negation", 3, "negated"), within("report", 6, "reported"), within("target", 5, "aimed")
    return compose(compose(negation, report, SYMBOLS), target, SYMBOLS)


@dataclass
class ToxicityModel:
    """words: hash to class; weights: one per pattern; bias; stems: hashes of beginnings of insults."""

    words: dict[int, int]
    weights: list[float]
    bias: float
    stems: frozenset[int] = frozenset()
    _tables: tuple | None = field(default=None, repr=False)

    def tables(self) -> tuple:
        if self._tables is None:
            machine = grammar()
            step = np.zeros((machine.n_states, len(SYMBOLS)), dtype=np.int32)
            emits = np.full((machine.n_states, len(SYMBOLS)), -1, dtype=np.int32)
            for (state, symbol), (out, to) in machine.arcs.items():
                step[state, SYMBOLS.index(symbol)] = to
                emits[state, SYMBOLS.index(symbol)] = PATTERNS.index(out) if out in PATTERNS else -1
            hashes = np.array(sorted(self.words), dtype=np.uint64)
            classes = np.array([self.words[int(h)] for h in hashes], dtype=np.int8)
            self._tables = step, emits, hashes, classes
        return self._tables

    def patterns(self, words: Words) -> np.ndarray:
        """How often each pattern occurs in each text: (texts, patterns).

        Only clauses with an insult or a threat can emit one, so only those are read.
        """
        step, emits, hashes, classes = self.tables()
        found = np.zeros((len(words.first) - 1, len(PATTERNS)))
        if not len(words.start):
            return found
        at = np.minimum(np.searchsorted(hashes, words.hashes), len(hashes) - 1)
        kind = np.where(hashes[at] == words.hashes, classes[at], OTHER)
        if self.stems:
            stems = np.array(sorted(self.stems), dtype=np.uint64)
            for begins in beginnings(words):
                at = np.minimum(np.searchsorted(stems, begins), len(stems) - 1)
                kind[(stems[at] == begins) & (kind == OTHER)] = LEARNED
        ends = np.concatenate([[0], np.cumsum(_CLAUSE_END[words.data])])
        doc = words.doc_of_word()
        new = np.ones(len(kind), dtype=bool)
        new[1:] = (np.diff(ends[words.start]) > 0) | (np.diff(doc) > 0)
        begins = np.flatnonzero(new)
        clause = np.cumsum(new) - 1
        for c in np.unique(clause[np.isin(kind, (INSULT, THREAT, LEARNED))]):
            lo = begins[c]
            hi = begins[c + 1] if c + 1 < len(begins) else len(kind)
            state = 0
            for symbol in kind[lo:hi].tolist():
                if emits[state, symbol] >= 0:
                    found[doc[lo], emits[state, symbol]] += 1
                state = step[state, symbol]
        return found

    def scores(self, words: Words) -> np.ndarray:
        z = np.log1p(self.patterns(words)) @ np.array(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def word_hash(word: str) -> int:
    return int(split_words(pa.array([word]), ALNUM).hashes[0])


def stem_ends(words: Words) -> Iterator[np.ndarray]:
    """For each length of STEMS, the end of each word's beginning; the word's own end where it is shorter."""
    letters = np.flatnonzero((words.data & 0xC0) != 0x80)
    edges = np.append(letters, len(words.data))
    at = np.searchsorted(letters, words.start)
    for length in STEMS:
        yield np.minimum(edges[np.minimum(at + length, len(letters))], words.end)


def beginnings(words: Words) -> Iterator[np.ndarray]:
    """For each length of STEMS, the hash of each word's beginning; that of the word where it is shorter."""
    for end in stem_ends(words):
        yield Words(words.first, words.start, end, words.data).hashes


def seed_words() -> dict[int, int]:
    return {word_hash(word): kind for kind, words in LEXICON.items() for word in words.split()}


@dataclass(frozen=True)
class ToxicityTrainer:
    """sample: about so many labelled documents teach at most, chosen by a hash of doc_id.
    odds, sure: the odds of an insult's contexts in toxic documents are at least so many times
    those in clean ones, and their logarithm lies so many standard errors above 0. smooth: contexts
    of either kind added to each count. prior: strength of the starting weights."""

    sample: int = 20_000
    odds: float = 20.0
    sure: float = 3.0
    smooth: float = 0.5
    prior: float = 0.5

    def fit(self, documents: DataFrame, labels: DataFrame) -> ToxicityModel:
        """Learns from documents whose doc_id has a label 0 or 1; repeated texts teach once."""
        marked = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic")).filter("toxic IN (0, 1)")
        share = self.sample / max(marked.count(), 1)
        if share < 1:
            marked = marked.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
        # The labels are bounded by the sample, so they can be broadcast.
        taught = stored(
            documents.select("doc_id", "text")
            .join(F.broadcast(marked), F.col("doc_id") == F.col("label_id"))
            .groupBy(F.xxhash64("text").alias("h"))
            .agg(F.max_by("text", "doc_id").alias("text"), F.max("toxic").alias("toxic"))
            .select("text", F.col("toxic").cast("int").alias("toxic")),
            "toxicity-sample",
        )
        context = "word long, stem string, context long, toxic int"
        n = F.count(F.lit(1))
        rows = stored(
            taught.mapInArrow(_contexts, context)
            .groupBy("word", "stem", "context")
            .agg(F.max("toxic").alias("toxic"))
            .groupBy("word", "stem")
            .agg(F.sum("toxic").alias("bad"), n.alias("n")),
            "toxicity-words",
        )
        totals = rows.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
        length = F.explode(F.sequence(F.lit(STEMS[0]), F.least(F.lit(STEMS[-1]), F.length("stem"))))
        stems = (
            rows.filter(F.length("stem") >= STEMS[0])
            .select("stem", "bad", "n", length.alias("k"))
            .groupBy(F.expr("substring(stem, 1, k)").alias("stem"))
            .agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
        )
        insult = self._insult(totals["bad"] or 0, totals["n"] or 0)
        words = seed_words()
        # Words and beginnings over these bounds are a fixed share of the bounded sample at most.
        for row in rows.filter(insult).select("word").collect():
            words.setdefault(row["word"] & 0xFFFFFFFFFFFFFFFF, LEARNED)
        begins = [row["stem"] for row in stems.filter(insult).select("stem").collect()]
        stem_hashes = split_words(pa.array(begins, pa.string()), ALNUM).hashes
        start = [2.0, 2.5, 0.5, 0.5] * 3
        model = ToxicityModel(words, start, -2.0, frozenset(stem_hashes.tolist()))

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    found = model.patterns(split_words(part.column("text"), ALNUM)).astype(np.int64)
                    names = [pa.array(found[:, i]) for i in range(len(PATTERNS))]
                    yield pa.RecordBatch.from_arrays(
                        [*names, part.column("toxic")], names=[*(f"f{i}" for i in range(len(PATTERNS))), "toxic"]
                    )

        columns = [f"f{i}" for i in range(len(PATTERNS))]
        schema = ", ".join(f"{c} long" for c in columns) + ", toxic int"
        cells = taught.mapInArrow(counted, schema).groupBy(*columns, "toxic").agg(n.alias("n")).collect()
        x = np.array([[r[c] for c in columns] for r in cells], dtype=float).reshape(-1, len(columns))
        y, weight = np.array([r["toxic"] for r in cells], dtype=float), np.array([r["n"] for r in cells], dtype=float)
        model.weights, model.bias = fitted(np.log1p(x), y, weight, np.array([*start, -2.0]), self.prior)
        return model

    def _insult(self, bad: int, n: int) -> Column:
        """Of rows with bad toxic ones of n contexts, among so many in all, those that are insults."""
        a, b = F.col("bad") + self.smooth, F.col("n") - F.col("bad") + self.smooth
        log_odds = F.log(a / (bad - a + 2 * self.smooth)) - F.log(b / (n - bad - b + 2 * self.smooth))
        return (log_odds >= float(np.log(self.odds))) & (log_odds >= self.sure * F.sqrt(1 / a + 1 / b))


def fitted(x: np.ndarray, y: np.ndarray, n: np.ndarray, start: np.ndarray, prior: float) -> tuple[list[float], float]:
    """Logistic regression by Newton steps, pulled towards the starting weights."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = start.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + prior * (w - start)
        curve = (x.T * (n * p * (1 - p))) @ x + prior * np.eye(len(w))
        move = np.linalg.solve(curve, gradient)
        w = w - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return [float(v) for v in w[:-1]], float(w[-1])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word with its neighbours, each once per chunk."""
    for batch in batches:
        for part in chunks(batch):
            words = split_words(part.column("text"), ALNUM)
            toxic = np.asarray(part.column("toxic").to_numpy(zero_copy_only=False), dtype=np.int32)
            h = words.hashes
            doc = words.doc_of_word()
            # The first and the last word of a text have no neighbour, whatever text lies beside.
            new = np.diff(doc) > 0
            before, after = np.zeros(len(h), dtype=np.uint64), np.zeros(len(h), dtype=np.uint64)
            before[1:][~new], after[:-1][~new] = h[:-1][~new], h[1:][~new]
            around = mix(before * np.uint64(3) + mix(after))
            *_, longest = stem_ends(words)
            data = words.data.tobytes()
            stem = [data[lo:hi].decode("utf-8", "replace") for lo, hi in zip(words.start.tolist(), longest.tolist(), strict=True)]
            columns = [h.view(np.int64), pa.array(stem, pa.string()), around.view(np.int64), toxic[doc]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], names=["word", "stem", "context", "toxic"]
            )


def scored(documents: DataFrame, model: ToxicityModel, column: str = "toxicity") -> DataFrame:
    """The documents' rows and columns, with a score."""
    schema = StructType([f for f in documents.schema if f.name != column] + [StructField(column, DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                values = model.scores(split_words(part.column("text"), ALNUM))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values)], names=[*part.schema.names, column])

    return documents.drop(column).mapInArrow(score, schema)


def kept(documents: DataFrame, model: ToxicityModel, limit: float = 0.5) -> DataFrame:
    """The documents that score below the limit; rows and columns unchanged."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                values = model.scores(split_words(part.column("text"), ALNUM))
                yield part.filter(pa.array(values < limit))

    return documents.mapInArrow(keep, documents.schema)
