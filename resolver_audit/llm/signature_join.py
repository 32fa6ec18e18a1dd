"""Exact n-gram Jaccard self-join with signature trees.

A document's set is its distinct word shingles; documents with equal sets are one class.
Classes that link share a shingle among the first fifth of their sets in any fixed order
(common shingles last), so classes meet in buckets of such shingles. A bucket is searched
with a signature tree: leaves hold classes ordered by size, inner nodes the OR of the token
bitmaps and the range of sizes below them, and a dual traversal drops pairs of nodes whose
greatest possible overlap is too small, and nodes that are known to be one component.
What is left is compared on the whole sets.

Components come in steps, so that a large group of near copies costs no square of its size:
first every class is compared with a pivot of each of its buckets, half of
them the class with the most common shingles (nearest to what the copies come from), half of
them random (in one or more rounds); then trees search only buckets that still hold different components. No link
between components is lost: a pair that links meets in a bucket, and is either compared there
or already in one component.

Defined results: null and empty texts, and texts without words, have an empty set and are
alone. A text with fewer words than a shingle is one shingle. Rows without doc_id are alone
and have no component. Repeated rows each get a row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resolver_audit.llm.components import components
from resolver_audit.llm.storage import broadcast_if_small, stored
from resolver_audit.llm.words import VISIBLE, chunks, mix, rolling, split_words

#: Counters of the sketch of shingle frequencies. The sketch only orders shingles: any fixed order is exact.
SKETCH = 1 << 18
_SKETCH_ROW = 1 << 14

Sets = Iterator[tuple[int, np.ndarray]]


def shingle_sets(texts: pa.Array, n: int) -> Sets:
    """(row, sorted distinct shingle hashes) of each text with words."""
    words = split_words(texts, VISIBLE)
    h = words.hashes
    grams = rolling(h, n)
    first, counts = words.first.tolist(), words.counts.tolist()
    for i, count in enumerate(counts):
        lo = first[i]
        if count >= n:
            yield i, np.unique(grams[lo : lo + count - n + 1])
        elif count:
            yield i, rolling(h[lo : lo + count], count)


def digest(tokens: np.ndarray) -> int:
    """64-bit name of a set; with the size of the set it names a class."""
    one = int(mix(tokens).sum(dtype=np.uint64))
    two = int(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return (one + 31 * two + (1 << 63)) % (1 << 64) - (1 << 63)


def bits_of(size: int) -> int:
    """Bits of a class's bitmap: a power of two, four times its size at least."""
    return max(64, 1 << (4 * size - 1).bit_length())


def bitmap(tokens: np.ndarray) -> bytes:
    bits = np.zeros(bits_of(len(tokens)), dtype=bool)
    bits[tokens & np.uint64(len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of 64-bit words brought to fewer bits; a token keeps its place modulo the bits."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


@dataclass
class Nodes:
    """One level of a tree; the members of node i are rows lo[i] to hi[i] - 1."""

    lo: np.ndarray
    hi: np.ndarray
    least: np.ndarray
    most: np.ndarray
    union: np.ndarray
    fewest: np.ndarray
    component: np.ndarray


_MIXED = np.iinfo(np.int64).min


def tree(size: np.ndarray, maps: np.ndarray, component: np.ndarray, fan: int) -> list[Nodes]:
    """Levels from the members to the root. Rows must be ordered by size."""
    n = len(size)
    at = np.arange(n)
    level = Nodes(at, at + 1, size, size, maps, np.bitwise_count(maps).sum(axis=1).astype(np.int64), component)
    levels = [level]
    while len(level.lo) > 1:
        cut = np.arange(0, len(level.lo), fan)
        same = np.minimum.reduceat(level.component, cut) == np.maximum.reduceat(level.component, cut)
        last = np.minimum(cut + fan, len(level.lo)) - 1
        level = Nodes(
            level.lo[cut], level.hi[last], np.minimum.reduceat(level.least, cut), np.maximum.reduceat(level.most, cut),
            np.bitwise_or.reduceat(level.union, cut, axis=0), np.minimum.reduceat(level.fewest, cut),
            np.where(same, level.component[cut], _MIXED),
        )
        levels.append(level)
    return levels


def possible(a: Nodes, i: np.ndarray, b: Nodes, j: np.ndarray, part: int) -> np.ndarray:
    """Whether members of node a[i] and b[j] can link: by component, size range and greatest overlap.

    A member x has at least fewest bits set, and at most the bits common to both unions can
    stand for shared tokens, so x shares at most |x| - (fewest - common) tokens.
    """
    apart = (a.component[i] != b.component[j]) | (a.component[i] == _MIXED)
    near = (100 * a.most[i] >= part * b.least[j]) & (100 * b.most[j] >= part * a.least[i])
    keep = np.flatnonzero(apart & near)
    i, j = i[keep], j[keep]
    width = min(a.union.shape[1], b.union.shape[1])
    ua, ub = folded(a.union, width), folded(b.union, width)
    common = np.bitwise_count(ua[i] & ub[j]).sum(axis=1).astype(np.int64)
    in_a = a.most[i] - np.maximum(0, fewest_bits(a, ua)[i] - common)
    in_b = b.most[j] - np.maximum(0, fewest_bits(b, ub)[j] - common)
    overlap = np.minimum(in_a, in_b)
    # Overlap o links sizes s and t only if 100 o >= part (s + t - o); the smallest sizes ask for least.
    fits = (100 + part) * overlap >= part * (a.least[i] + b.least[j])
    out = np.zeros(len(apart), dtype=bool)
    out[keep[fits]] = True
    return out


def fewest_bits(nodes: Nodes, union: np.ndarray) -> np.ndarray:
    """Folding merges bits, so after it only members' own bitmaps (leaves) tell how many are set."""
    if union.shape[1] == nodes.union.shape[1]:
        return nodes.fewest
    if (nodes.hi - nodes.lo == 1).all():
        return np.bitwise_count(union).sum(axis=1).astype(np.int64)
    return np.zeros(len(nodes.lo), dtype=np.int64)


def tree_pairs(a: list[Nodes], b: list[Nodes] | None, part: int, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal from the roots; member rows (x of a, y of b) that may link. b None: a with itself."""
    own = b is None
    b = a if own else b
    la, lb = len(a) - 1, len(b) - 1
    i, j = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while True:
        keep = possible(a[la], i, b[lb], j, part)
        i, j = i[keep], j[keep]
        if (la == 0 and lb == 0) or not len(i):
            break
        if la >= lb:
            i, j = _children(i, j, len(a[la - 1].lo), fan)
            la -= 1
            if own and lb:
                j, i = _children(j, i, len(b[lb - 1].lo), fan)
                lb -= 1
        else:
            j, i = _children(j, i, len(b[lb - 1].lo), fan)
            lb -= 1
        if own:
            keep = i <= j
            i, j = i[keep], j[keep]
    if own:
        keep = i < j
        i, j = i[keep], j[keep]
    return i, j


def _children(open_: np.ndarray, other: np.ndarray, n: int, fan: int) -> tuple[np.ndarray, np.ndarray]:
    child = (open_[:, None] * fan + np.arange(fan)).ravel()
    other = np.repeat(other, fan)
    return child[child < n], other[child < n]


@dataclass(frozen=True)
class SignatureJoin:
    """words: of a shingle. percent: least Jaccard similarity, in hundredths.
    fan: children of a node. block: classes in a tree; larger buckets are split into several trees.
    rounds: of comparisons with pivots. colours: random pivots in a bucket's stead, so many."""

    words: int = 5
    percent: int = 80
    fan: int = 8
    block: int = 512
    rounds: int = 1
    colours: int = 8

    def frequencies(self, documents: DataFrame) -> np.ndarray:
        """Sketch of how many documents hold a shingle, over all documents; SKETCH counters, whatever the input."""
        n = self.words

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(SKETCH, dtype=np.int64)
            for batch in batches:
                for part in chunks(batch):
                    sets = [tokens for _, tokens in shingle_sets(part.column("text"), n)]
                    if sets:
                        at = (np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64)
                        total += np.bincount(at, minlength=SKETCH)
            yield _sketch_rows(total, range(0, SKETCH, _SKETCH_ROW))

        def add(group: pa.Table) -> pa.Table:
            counts = sum(np.frombuffer(x, dtype=np.int64) for x in group["counts"].to_pylist())
            return pa.table({"at": group["at"][:1], "counts": pa.array([counts.tobytes()], pa.binary())})

        schema = "at long, counts binary"
        sketches = documents.select("text").mapInArrow(count, schema)
        # Two steps, so that no group holds more than about the square root of all sketches.
        salted = sketches.groupBy("at", F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt")).applyInArrow(add, schema)
        rows = salted.groupBy("at").applyInArrow(add, schema).collect()
        total = np.zeros(SKETCH, dtype=np.int64)
        for row in rows:
            total[row["at"] : row["at"] + _SKETCH_ROW] = np.frombuffer(row["counts"], dtype=np.int64)
        return total

    def signed(self, documents: DataFrame) -> DataFrame:
        """A row for each document (doc_id, cls, n, central, bitmap), and one for each token of its prefix (cls, token)."""
        weights = documents.sparkSession.sparkContext.broadcast(self.frequencies(documents))
        n_words, percent = self.words, self.percent

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight = weights.value
            for batch in batches:
                for part in chunks(batch):
                    ids = part.column("doc_id").to_pylist()
                    sizes = np.zeros(len(ids), dtype=np.int32)
                    names = np.zeros(len(ids), dtype=np.int64)
                    maps = [b""] * len(ids)
                    central = np.zeros(len(ids), dtype=np.int64)
                    prefixes, owners = [], []
                    for i, tokens in shingle_sets(part.column("text"), n_words):
                        size = len(tokens)
                        sizes[i], names[i], maps[i] = size, digest(tokens), bitmap(tokens)
                        common = weight[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)]
                        central[i] = int(1000 * np.log(common + 1).mean())
                        if ids[i] is not None:
                            order = np.lexsort((tokens, common))
                            prefix = tokens[order[: size - (percent * size + 99) // 100 + 1]]
                            prefixes.append(prefix)
                            owners.append(np.full(len(prefix), i))
                    yield _rows(
                        pa.array(names), part.column("doc_id"), pa.array(sizes), pa.array(central), pa.array(maps, pa.binary())
                    )
                    if prefixes:
                        owner, token = np.concatenate(owners), np.concatenate(prefixes).view(np.int64)
                        yield _rows(pa.array(names[owner]), token=pa.array(token))

        source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        return source.mapInArrow(sign, "doc_id long, cls long, n int, central long, bitmap binary, token long")

    def sets(self, documents: DataFrame, wanted: DataFrame) -> DataFrame:
        """(cls, n, tokens) for wanted (doc_id, cls): each class's set from a document of it; rows that
        share that doc_id and set repeat it."""
        wanted = wanted.select(F.col("doc_id").alias("wanted_id"), "cls")
        texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
            broadcast_if_small(wanted), F.col("doc_id") == F.col("wanted_id")
        )
        n_words = self.words

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    names = part.column("cls").to_pylist()
                    found = [
                        (names[i], len(t), t.tobytes())
                        for i, t in shingle_sets(part.column("text"), n_words)
                        if digest(t) == names[i]
                    ]
                    columns = zip(*found, strict=True) if found else ((), (), ())
                    kinds = (pa.int64(), pa.int32(), pa.binary())
                    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["cls", "n", "tokens"])

        return texts.select("cls", "text").mapInArrow(collect, "cls long, n int, tokens binary")

    def plausible(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes and bitmaps allow a link: the test of two leaves."""
        part = self.percent

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = [batch.column(c).to_pylist() for c in ("n_a", "n_b")]
                keep = np.zeros(batch.num_rows, dtype=bool)
                for i in range(batch.num_rows):
                    a, b = (
                        np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.uint64)[None, :] for c in ("map_a", "map_b")
                    )
                    width = min(a.shape[1], b.shape[1])
                    a, b = folded(a, width), folded(b, width)
                    common = int(np.bitwise_count(a & b).sum())
                    s, t = sizes[0][i], sizes[1][i]
                    overlap = min(s - int(np.bitwise_count(a).sum()), t - int(np.bitwise_count(b).sum())) + common
                    keep[i] = (100 + part) * overlap >= part * (s + t)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

        a = classes.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("bitmap").alias("map_a"))
        b = classes.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("bitmap").alias("map_b"))
        return pairs.join(a, "a").join(b, "b").mapInArrow(test, "a long, b long")

    def linked(self, documents: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that link, by their whole sets."""
        ends = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
        wanted = stored(classes.select("cls", "doc_id").join(ends, "cls", "left_semi"), "wanted")
        sets = stored(self.sets(documents, wanted), "sets")
        percent = self.percent

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = batch.column("set_a"), batch.column("set_b")
                keep = np.zeros(batch.num_rows, dtype=bool)
                for i in range(batch.num_rows):
                    x, y = (np.frombuffer(s[i].as_buffer(), dtype=np.uint64) for s in (a, b))
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep[i] = 100 * common >= percent * (len(both) - common)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

        left = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("set_a"))
        right = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("set_b"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(verify, "a long, b long").distinct()

    def join(self, documents: DataFrame) -> DataFrame:
        """doc_id, n_shingles, component_id: a row for each document."""
        signed = stored(self.signed(documents), "signed")
        docs = signed.filter("token IS NULL").select("doc_id", "cls", "n")
        classes = stored(
            signed.filter("token IS NULL AND n > 0 AND doc_id IS NOT NULL")
            .groupBy("cls")
            .agg(
                F.min("doc_id").alias("doc_id"), F.first("n").alias("n"),
                F.first("central").alias("central"), F.first("bitmap").alias("bitmap"),
            ),
            "classes",
        )
        tokens = signed.filter("token IS NOT NULL").select("token", "cls")
        shared = tokens.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo < hi")
        members = stored(
            tokens.join(shared.select(F.col("token").alias("t")), F.col("token") == F.col("t"), "left_semi").distinct(),
            "members",
        )
        # An empty range needs no Python worker beside those of the tasks.
        links = documents.sparkSession.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
        known = links.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
        for turn in range(self.rounds):
            pairs = self.stars(self.open_buckets(members, known), classes, turn)
            pairs = stored(self.plausible(pairs, classes), "stars")
            links = stored(links.union(self.linked(documents, pairs, classes)), "links")
            known = stored(components(links), "known")
        rest = stored(self.searched(self.open_buckets(members, known), classes), "rest")
        more = stored(self.linked(documents, rest, classes), "links")
        final = known if more.isEmpty() else components(links.union(more))
        named = (
            classes.join(final, F.col("cls") == F.col("vertex"), "left")
            .select("cls", "doc_id", F.coalesce("component", "cls").alias("component"))
        )
        least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        found = named.join(least, "component").select(F.col("cls").alias("c"), "component_id")
        with_set = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("cls"))
        return docs.withColumn("key", with_set).join(found, F.col("key") == F.col("c"), "left").select(
            "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
        )

    def open_buckets(self, members: DataFrame, known: DataFrame) -> DataFrame:
        """(token, cls, component, size) of buckets that hold several components, one of those with equal members."""
        now = members.join(known, F.col("cls") == F.col("vertex"), "left").select(
            "token", "cls", F.coalesce("component", "cls").alias("component")
        )
        now = stored(now, "members-now")
        buckets = (
            now.groupBy("token")
            .agg(
                F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"),
                F.sum(F.xxhash64("cls") % (1 << 40)).alias("sum"), F.bit_xor(F.xxhash64("cls")).alias("xor"),
            )
            .filter("lo < hi")
            .groupBy("size", "sum", "xor")
            .agg(F.min("token").alias("t"))
            .select("t", "size")
        )
        return stored(now.join(buckets, F.col("token") == F.col("t")).select("token", "cls", "component", "size"), "open")

    def stars(self, buckets: DataFrame, classes: DataFrame, turn: int) -> DataFrame:
        """Pairs (a, b) of classes of different components: each member with the pivot of its bucket."""
        traits = classes.select(F.col("cls").alias("c"), "n", "central")
        placed = buckets.join(traits, F.col("cls") == F.col("c")).drop("c")
        colour = F.pmod(F.xxhash64("token", F.lit(turn)), F.lit(2 * self.colours))
        order = F.when(colour < self.colours, F.col("central")).otherwise(F.xxhash64("cls", colour))
        pivots = placed.groupBy("token").agg(
            F.max(F.struct(order.alias("order"), "cls", "n", "component")).alias("pivot")
        )
        least, most = F.least("n", "pivot.n"), F.greatest("n", "pivot.n")
        return (
            placed.join(pivots, "token")
            .filter((F.col("component") != F.col("pivot.component")) & (100 * least >= self.percent * most))
            .select(F.least("cls", "pivot.cls").alias("a"), F.greatest("cls", "pivot.cls").alias("b"))
            .distinct()
        )

    def searched(self, buckets: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components that the trees cannot rule out.

        A bucket with more classes than a block is dealt to several trees by hash; a task gets two at most.
        """
        part, fan = self.percent, self.fan
        signed = classes.select(F.col("cls").alias("c"), F.col("n").cast("long").alias("n"), "bitmap")
        trees = F.ceil(F.col("size") / self.block).cast("int")
        dealt = (
            buckets.withColumn("trees", trees)
            .withColumn("own", F.pmod(F.xxhash64("cls"), F.col("trees")))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
            .select(
                "token", "cls", "component", F.col("own").cast("int").alias("own"),
                F.least("own", "other").cast("int").alias("x"), F.greatest("own", "other").cast("int").alias("y"),
            )
            .join(signed, F.col("cls") == F.col("c"))
            .drop("c")
        )
        keys = ["token", "x", "y"]

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in _groups(batches, keys):
                a, b = bucket_pairs(group, part, fan)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return (
            dealt.repartition(n, *keys)
            .sortWithinPartitions(*keys, "n", "cls")
            .mapInArrow(search, "a long, b long")
            .distinct()
        )


def bucket_pairs(group: pa.Table, part: int, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """Class pairs of one tree, or of two, that may link; rows are ordered by size."""
    own, x, y = (group[c].to_numpy() for c in ("own", "x", "y"))
    cls, size, component = (group[c].to_numpy() for c in ("cls", "n", "component"))
    maps = group["bitmap"].to_pylist()
    width = np.array([len(m) // 8 for m in maps])
    sides = (own == x, own == y) if x[0] != y[0] else (np.ones(len(own), dtype=bool),)
    trees = [
        [
            (rows, tree(size[rows], np.stack([np.frombuffer(maps[r], dtype=np.uint64) for r in rows]), component[rows], fan))
            for w in np.unique(width)
            if len(rows := np.flatnonzero(side & (width == w)))
        ]
        for side in sides
    ]
    out_a, out_b = [], []
    for i, (rows_a, a) in enumerate(trees[0]):
        for k, (rows_b, b) in enumerate(trees[-1]):
            if len(trees) == 1 and k < i:
                continue
            p, q = tree_pairs(a, None if len(trees) == 1 and k == i else b, part, fan)
            out_a.append(cls[rows_a[p]])
            out_b.append(cls[rows_b[q]])
    a, b = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (out_a, out_b))
    return np.minimum(a, b), np.maximum(a, b)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys; a run may go over several batches."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        columns = [held[k].to_numpy() for k in keys]
        new = np.zeros(held.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield held.slice(lo, hi - lo).combine_chunks()
        held = held.slice(cuts[-1]).combine_chunks()
    if held is not None:
        yield held


def _sketch_rows(total: np.ndarray, starts: range) -> pa.RecordBatch:
    blobs = [total[s : s + _SKETCH_ROW].tobytes() for s in starts]
    return pa.RecordBatch.from_arrays([pa.array(list(starts), pa.int64()), pa.array(blobs, pa.binary())], names=["at", "counts"])


def _rows(cls, ids=None, n=None, central=None, maps=None, token=None) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "n": pa.int32(), "central": pa.int64(), "bitmap": pa.binary(), "token": pa.int64()}
    given = dict(zip(kinds, (ids, n, central, maps, token), strict=True))
    columns = {k: pa.nulls(len(cls), kinds[k]) if v is None else v for k, v in given.items()} | {"cls": cls}
    order = ["doc_id", "cls", "n", "central", "bitmap", "token"]
    return pa.RecordBatch.from_arrays([columns[k] for k in order], names=order)


def unused_name(frame: DataFrame, name: str) -> str:
    """A name that no column of the frame has."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name += "_"
    return name


def representatives(documents: DataFrame, join: SignatureJoin) -> DataFrame:
    """The documents of which each is the smallest doc_id of its component; columns unchanged.

    Rows that repeat a doc_id and its text become one. A doc_id with several texts goes if one of them
    links to a smaller doc_id. Rows without doc_id stay.
    """
    found = stored(join.join(documents), "components")
    other_id = unused_name(documents, "other_id")
    dropped = found.filter("component_id != doc_id").select(F.col("doc_id").alias(other_id)).distinct()
    repeated = found.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias(other_id))
    dropped, repeated = stored(dropped, "dropped"), stored(repeated, "repeated")

    def ids(frame: DataFrame) -> tuple[DataFrame, object]:
        return broadcast_if_small(frame), F.col("doc_id").cast("long") == F.col(other_id)

    kept = documents.join(*ids(dropped), "left_anti")
    single = kept.join(*ids(repeated), "left_anti")
    return single.unionByName(kept.join(*ids(repeated), "left_semi").dropDuplicates(["doc_id", "text"]))
