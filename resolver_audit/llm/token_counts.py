"""Counts the tokens of whole texts with a tokenizer that is compiled to a finite-state transducer.

The tokenizer is a byte-level BPE with word ends. A word's symbols are its bytes, the last one
marked: an alphabet of 512. A prefix p of a word has a last token by BPE, and the tokens before it
are those of the shorter prefix in front of it: a token u may follow a token v exactly if BPE takes
the two apart again. So what a prefix has to remember is finite. A state holds the longest end x of
p that begins some token (only tokens that start inside x can still grow over the end of p), and
for each place in x the last token up to there and how many tokens more or less than at the end of
p. Reading a symbol finds the one token that ends there and fits the token before it. Transitions
are annotated with the change of the number of tokens, and a word's last symbol leads back to the
first state. They are compiled when a text first needs them and forgotten when there are too many.

A text's symbols are cut into chunks of CHUNK symbols, and all chunks of many texts run side by
side. A chunk that holds a word's beginning ends in a state that does not depend on what came
before; of the part before that beginning, and of a chunk inside a long word, each chunk has a
state map from the states it may begin in to the state and count at its end. Maps begin with the
state that the left neighbour suggests. A scan composes the maps along each text by pointer
doubling; where a map lacks the state that its left neighbour ends in, it gets that entry and the
scan runs again.

Splitting into words is finite-state too, by character classes. Class and lower case of a character
are asked of the tokenizer itself when a character is first met; texts with characters that may
combine are normalised by it.

Defined results: a null or empty text has no bytes and no tokens. The special tokens' strings in a
text are one token each, as is the library's default. Repeated rows have a result each; a null
doc_id stays null. Other columns play no part. Long texts are read in parts that are cut at blanks.
An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from resolver_audit.llm.words import chunks

CHUNK = 64
#: Characters of a part of a text, and transitions that are remembered.
PART = 1 << 16
TRANSITIONS = 1 << 18

COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

# The kind of tokenizer that is compiled here, as its file names it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
FINAL = 256
_BLANK = re.compile(r" (?=\S)(?<=\S )")


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte: itself where it is printable, else the next one from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """The BPE itself: tokens as strings of symbols, and which two tokens make which."""

    def __init__(self, merges: list[list[str]], suffix: str):
        self.token: dict[str, int] = {}
        self.symbols: list[str] = []
        named: dict[str, int] = {}
        for char, b in byte_symbols().items():
            for name, symbol in ((char, b), (char + suffix, b + FINAL)):
                named[name] = self._add(chr(symbol))
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            a, b = named[left], named[right]
            made = self._add(self.symbols[a] + self.symbols[b])
            named[left + right] = made
            self.pairs.setdefault((a, b), (rank, made))

    def _add(self, symbols: str) -> int:
        number = self.token.setdefault(symbols, len(self.symbols))
        if number == len(self.symbols):
            self.symbols.append(symbols)
        return number

    def apply(self, symbols: str) -> list[int]:
        """The tokens of a string of symbols: of all neighbours that merge, the lowest rank first, the left one of equals."""
        tokens = [self.token[s] for s in symbols]
        while len(tokens) > 1:
            found = [(self.pairs[p][0], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in self.pairs]
            if not found:
                break
            _, at = min(found)
            tokens[at : at + 2] = [self.pairs[tokens[at], tokens[at + 1]][1]]
        return tokens


class Transducer:
    """States and transitions, compiled as they are met. State 0 is the beginning of a word."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.prefixes = {t[:i] for t in merges.token for i in range(len(t) + 1)}
        self.forget()

    def forget(self) -> None:
        self.alone: dict[int, bool] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        # Place by place in x, the last token there (-1: the word begins) and its count less that at the end.
        self.states: list[tuple[str, tuple[int, ...], tuple[int, ...]]] = [("", (-1,), (0,))]
        self.number = {self.states[0]: 0}
        self.size = 0
        self._room(1 << 12)

    def _room(self, slots: int) -> None:
        self.keys = np.full(slots, -1, dtype=np.int64)
        self.next = np.zeros(slots, dtype=np.int32)
        self.delta = np.zeros(slots, dtype=np.int32)

    def may_follow(self, before: int, token: int) -> bool:
        """Whether BPE gives these two tokens for their symbols; before is -1 at a word's beginning."""
        merges = self.merges
        if token not in self.alone:
            self.alone[token] = merges.apply(merges.symbols[token]) == [token]
        if not self.alone[token] or before < 0:
            return self.alone[token]
        pair = before, token
        if pair not in self.fits:
            self.fits[pair] = merges.apply(merges.symbols[before] + merges.symbols[token]) == [before, token]
        return self.fits[pair]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state, and the change of the number of tokens."""
        x, last, counts = self.states[state]
        y = x + chr(symbol)
        for at in range(len(y)):
            token = self.merges.token.get(y[at:])
            if token is not None and self.may_follow(last[at], token):
                break
        else:
            raise ValueError("no token fits")
        change = counts[at] + 1
        if symbol >= FINAL:
            return 0, change
        keep = next(i for i in range(len(y) + 1) if y[i:] in self.prefixes)
        key = (
            y[keep:],
            (*last[keep:], token) if keep < len(y) else (token,),
            (*(c - change for c in counts[keep:]), 0) if keep < len(y) else (0,),
        )
        number = self.number.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
        return number, change

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands, or the free slot where it would stand."""
        mask = len(self.keys) - 1
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        slots = (mixed >> np.uint64(32)).astype(np.int64) & mask
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & mask
            held = self.keys[slots[open_]]
            open_ = open_[(held != keys[open_]) & (held != -1)]
        return slots

    def _insert(self, key: int, to: int, delta: int) -> None:
        mask = len(self.keys) - 1
        slot = ((key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 32) & mask
        while self.keys[slot] != -1:
            slot = (slot + 1) & mask
        self.keys[slot], self.next[slot], self.delta[slot] = key, to, delta

    def _compile(self, keys: list[int]) -> None:
        if (self.size + len(keys)) * 2 > len(self.keys):
            held = self.keys >= 0
            old = [x[held].tolist() for x in (self.keys, self.next, self.delta)]
            self._room(1 << ((self.size + len(keys)) * 4).bit_length())
            for entry in zip(*old, strict=True):
                self._insert(*entry)
        for key in keys:
            self._insert(key, *self.step(key >> 9, key & 511))
        self.size += len(keys)

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of many (state, symbol) at once."""
        keys = (states << 9) | symbols
        slots = self._slots(keys)
        missing = self.keys[slots] != keys
        if missing.any():
            self._compile(np.unique(keys[missing]).tolist())
            slots = self._slots(keys)
        return self.next[slots].astype(np.int64), self.delta[slots]

    def run(self, stream, states, begin, end) -> tuple[np.ndarray, np.ndarray]:
        """Reads stream[begin:end] from each state, all side by side: last states and token counts."""
        states, counts = states.copy(), np.zeros(len(states), dtype=np.int64)
        order = np.argsort(begin - end, kind="stable")
        length = (end - begin)[order]
        at, now = begin[order], states[order]
        count = np.zeros(len(order), dtype=np.int64)
        for step in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -step, side="left"))
            now[:n], change = self.advance(now[:n], stream[at[:n] + step])
            count[:n] += change
        states[order], counts[order] = now, count
        return states, counts


@dataclass
class Scan:
    """Counts the tokens of texts whose symbols stand one after the other; text i has first[i] to first[i + 1] - 1."""

    transducer: Transducer
    stream: np.ndarray
    first: np.ndarray
    chunk: int = CHUNK

    def counts(self) -> np.ndarray:
        n_texts = len(self.first) - 1
        size = np.diff(self.first)
        per_text = -(-size // self.chunk)
        n = int(per_text.sum())
        if not n:
            return np.zeros(n_texts, dtype=np.int64)
        text = np.repeat(np.arange(n_texts), per_text)
        leader = np.concatenate([[0], np.cumsum(per_text)])[:-1]
        begin = self.first[text] + (np.arange(n) - leader[text]) * self.chunk
        end = np.minimum(begin + self.chunk, self.first[text + 1])
        last = np.append(text[1:] != text[:-1], True)
        # Where the first word that begins in a chunk begins; a text begins with a word.
        words = np.flatnonzero(np.append(True, self.stream[:-1] >= FINAL))
        found = np.searchsorted(words, begin)
        head = np.append(words, len(self.stream))[found]
        closed = head < end
        head = np.minimum(head, end)
        start = np.zeros(n, dtype=np.int64)
        tail_state, tail_count = self.transducer.run(self.stream, start, np.where(closed, head, begin), end)
        tail_count = np.where(closed, tail_count, 0)
        # The entries of the state maps: chunk, state at its beginning, state and count at its end.
        chunk, into = np.arange(n), np.where(begin == self.first[text], 0, np.append(0, tail_state[:-1]))
        out, count = self._entries(chunk, into, begin, head, closed, tail_state, tail_count)
        while True:
            key = (chunk << 32) | into
            order = np.argsort(key)
            wanted = ((chunk + 1) << 32) | out
            at = np.minimum(np.searchsorted(key[order], wanted), len(key) - 1)
            known = key[order][at] == wanted
            done, lacking = len(chunk), len(chunk) + 1
            jump = np.where(last[chunk], done, np.where(known, order[at], lacking))
            totals, reached = doubled(np.append(count, [0, 0]), np.append(jump, [done, lacking]))
            # The first n entries of texts' first chunks begin with the first state.
            if (reached[leader[per_text > 0]] == done).all():
                break
            more = np.unique(wanted[jump == lacking])
            new_chunk, new_into = more >> 32, more & 0xFFFFFFFF
            new_out, new_count = self._entries(new_chunk, new_into, begin, head, closed, tail_state, tail_count)
            chunk, into = np.concatenate([chunk, new_chunk]), np.concatenate([into, new_into])
            out, count = np.concatenate([out, new_out]), np.concatenate([count, new_count])
        result = np.zeros(n_texts, dtype=np.int64)
        result[per_text > 0] = totals[leader[per_text > 0]]
        return result

    def _entries(self, chunk, into, begin, head, closed, tail_state, tail_count) -> tuple[np.ndarray, np.ndarray]:
        state, count = self.transducer.run(self.stream, into, begin[chunk], head[chunk])
        return np.where(closed[chunk], tail_state[chunk], state), count + tail_count[chunk]


def doubled(counts: np.ndarray, jump: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts along the jumps, and where they end: on an entry that jumps to itself and counts 0."""
    while True:
        further = jump[jump]
        if (further == jump).all():
            return counts + np.where(jump == np.arange(len(jump)), 0, counts[jump]), jump
        counts, jump = counts + counts[jump], further


class Splitter:
    """Texts as streams of symbols: normalised, split into words, the last byte of a word marked."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.kind = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)

    def _learn(self, points: np.ndarray) -> None:
        """Asks the tokenizer for the class and the lower case of characters."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for point in points.tolist():
            char = chr(point)
            self.kind[point] = OTHER
            if not split(char):
                self.kind[point] = SPACE
            elif len(split("a" + char)) == 1:
                self.kind[point] = LETTER
            elif len(split("!" + char)) != 1:
                self.kind[point] = NUMBER
            low = self.tokenizer.normalizer.normalize_str(char)
            if len(low) == 1 and self.kind[point] != SPACE:
                self.lower[point] = ord(low)

    def normalised(self, text: str) -> str:
        """A text in lower case with its characters composed; white space may stay as it is."""
        if text.isascii():
            return text.lower()
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        # Below U+0300 nothing combines; U+0130 is the one that grows in lower case.
        if points.max() < 0x300 and "İ" not in text:
            self._meet(points)
            return self.lower[points].astype("<u4").tobytes().decode("utf-32-le")
        return self.tokenizer.normalizer.normalize_str(text)

    def _meet(self, points: np.ndarray) -> np.ndarray:
        kind = self.kind[points]
        if (kind == UNKNOWN).any():
            self._learn(np.unique(points[kind == UNKNOWN]))
            kind = self.kind[points]
        return kind

    def streams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of normalised texts, and where each text's symbols begin."""
        joined = "".join(t + " " for t in texts)
        data = np.frombuffer(joined.encode(), dtype=np.uint8)
        points = data if len(data) == len(joined) else np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        kind = self._meet(points)
        n = len(points)
        begins = kind != SPACE
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        ends = np.append(begins[1:] | (kind[1:] == SPACE), True)
        for at, to in self._contractions(points, begins):
            begins[at + 1] = False
            ends[at] = False
            ends[to - 1] = True
            inside = to < n
            begins[to[inside]] |= kind[to[inside]] != SPACE
            for between in range(1, int(to[0] - at[0]) - 1):
                ends[at + between] = False
        width = np.ones(n, dtype=np.int64)
        for limit in (0x80, 0x800, 0x10000):
            width += points >= limit
        stop = np.cumsum(width)
        symbols = data.astype(np.int64)
        marked = ends & (kind != SPACE)
        symbols[stop[marked] - 1] += FINAL
        shown = np.repeat(kind != SPACE, width)
        sizes = np.array([len(t.encode()) + 1 for t in texts])
        before = np.concatenate([[0], np.cumsum(shown)])
        return symbols[shown], before[np.concatenate([[0], np.cumsum(sizes)])]

    @staticmethod
    def _contractions(points: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Apostrophes that begin a word and go on as a contraction, and the places after it, by length."""
        quote = np.flatnonzero(begins & (points == ord("'")))
        for length in (1, 2):
            at = quote[quote + length < len(points)]
            hit = np.zeros(len(at), dtype=bool)
            for tail in CONTRACTIONS:
                if len(tail) == length:
                    same = points[at + 1] == ord(tail[0])
                    hit |= same & (points[at + length] == ord(tail[-1]))
            if hit.any():
                yield at[hit], at[hit] + length + 1


class Counter:
    """Counts tokens of texts as the tokenizers library does by a tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text())
        model, splits = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if (
            model["type"] != "BPE" or not model.get("end_of_word_suffix") or kinds != NORMALIZERS
            or [s["type"] for s in splits] != ["Split", "ByteLevel"] or splits[0]["pattern"] != {"Regex": PATTERN}
        ):
            raise ValueError(f"{path} is not a byte-level BPE with word ends")
        self.splitter = Splitter(Tokenizer.from_file(path))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.transducer = Transducer(Merges(merges, model["end_of_word_suffix"]))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def sections(self, text: str) -> tuple[list[str], int]:
        """Normalised parts between the special tokens of a text, and the number of these."""
        between = self.special.split(text) if self.special else [text]
        cut = [p for section in between for p in parts(section) if p]
        return [self.splitter.normalised(p) for p in cut], len(between) - 1

    def counts(self, texts: list[str]) -> np.ndarray:
        if self.transducer.size > TRANSITIONS:
            self.transducer.forget()
        sections = [self.sections(t) for t in texts]
        total = np.array([n for _, n in sections], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(s) for s, _ in sections])
        flat = [p for s, _ in sections for p in s]
        if flat:
            np.add.at(total, owner, Scan(self.transducer, *self.splitter.streams(flat)).counts())
        return total


def parts(text: str, limit: int = PART) -> list[str]:
    """The text cut at blanks between characters that are no white space, which belong to no word."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = _BLANK.search(text, at + limit)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


@cache
def counter(path: str) -> Counter:
    return Counter(path)


@dataclass(frozen=True)
class TokenCounts:
    """Counts by the tokenizer file at path; texts of over limit tokens are marked."""

    path: str
    limit: int = 2048

    def count(self, documents: DataFrame) -> DataFrame:
        """``doc_id, n_bytes, n_tokens, over_limit`` of every document, in the tasks of the scan."""
        path, limit = self.path, self.limit

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = counter(path)
            for batch in batches:
                for part in chunks(batch, limit=1 << 19):
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    n = count.counts(texts)
                    sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
                    columns = [part.column(0).cast(pa.int64()), sizes, pa.array(n), pa.array(n > limit)]
                    yield pa.record_batch(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return documents.select("doc_id", "text").mapInArrow(run, COUNTED)
