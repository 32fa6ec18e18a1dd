"""Nearest neighbours by vantage-point trees, one tree per shard.

Nearness is the largest inner product. Vectors get one more coordinate that brings all to
the norm of the longest, queries get a zero there; then the nearest by distance are those of
largest inner product, and the triangle inequality holds. A tree node parts its vectors by
their distance to a vantage point, nearer half and farther half, and keeps the range of each
half. A half is left out for a query when its least possible distance is over factor times
the distance of the worst neighbour found so far. Factor 1 is exact; a smaller factor prunes
more and may miss some.

Every shard is searched for every block of queries, and the best of all shards are kept.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components,
and those of another length than most, take no part, nor do rows without vec_id. Ties go to
the smaller vec_id. Rows that share a vec_id are candidates each, but never of their own id.
Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resolver_audit.llm.storage import stored


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b in double precision.

    Summed component by component, so that equal vectors give equal products wherever they stand.
    """
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += a[:, i, None] * b[None, :, i]
    return out


@dataclass
class VpTree:
    """Nodes in preorder: vantage row, ranges of both halves; leaves hold rows first to last - 1."""

    ids: np.ndarray
    vectors: np.ndarray
    vantage: np.ndarray
    ranges: np.ndarray
    far_child: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray, top: float, leaf: int) -> VpTree:
        """top: the largest norm of all shards. Deterministic: vantage points follow from the ids."""
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order].astype(np.float64)
        lifted = np.hstack([vectors, np.sqrt(np.maximum(0, top**2 - (vectors**2).sum(axis=1)))[:, None]])
        place = np.arange(len(ids))
        nodes: list[list] = []
        stack = [(0, len(ids), -1)]
        while stack:
            lo, hi, parent = stack.pop()
            number = len(nodes)
            if parent >= 0:
                nodes[parent][2] = number
            if hi - lo <= leaf:
                nodes.append([-1, (0.0, 0.0, 0.0, 0.0), -1, lo, hi])
                continue
            rows = place[lo:hi]
            # The vector farthest from the first one lies at the edge, where distances spread most.
            start = lifted[rows[0]]
            vantage = int(rows[np.argmax(((lifted[rows] - start) ** 2).sum(axis=1))])
            distance = np.sqrt(((lifted[rows] - lifted[vantage]) ** 2).sum(axis=1))
            by = np.argsort(distance, kind="stable")
            place[lo:hi], distance = rows[by], distance[by]
            half = (hi - lo) // 2
            nodes.append([vantage, (distance[0], distance[half - 1], distance[half], distance[-1]), -1, lo, hi])
            stack.append((lo + half, hi, number))
            stack.append((lo, lo + half, -1))
        back = np.empty(len(place), dtype=np.int64)
        back[place] = np.arange(len(place))
        vantage, ranges, far, first, last = zip(*nodes, strict=True) if nodes else ((),) * 5
        at = np.array([back[v] if v >= 0 else -1 for v in vantage], dtype=np.int64)
        return VpTree(
            ids[place], vectors[place], at, np.array(ranges, dtype=np.float64).reshape(-1, 4),
            np.array(far, dtype=np.int64), np.array(first, dtype=np.int64), np.array(last, dtype=np.int64),
        )

    def arrays(self) -> list[np.ndarray]:
        return [self.ids, self.vectors.astype("<f4"), self.vantage, self.ranges, self.far_child, self.first, self.last]

    def dump(self) -> bytes:
        arrays = self.arrays()
        head = np.array([len(self.ids), self.vectors.shape[1], len(self.vantage)], dtype="<i8")
        return head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)

    @staticmethod
    def load(data: bytes) -> VpTree:
        n, d, m = np.frombuffer(data, "<i8", 3).tolist()
        at, out = 24, []
        for kind, shape in (("<i8", (n,)), ("<f4", (n, d)), ("<i8", (m,)), ("<f8", (m, 4)), *[("<i8", (m,))] * 3):
            size = int(np.prod(shape))
            out.append(np.frombuffer(data, kind, size, at).reshape(shape))
            at += size * np.dtype(kind).itemsize
        out[1] = out[1].astype(np.float64)
        return VpTree(*out)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, top: float, factor: float) -> Best:
        """The k nearest of each query.

        First each query is compared with the leaf that it falls into, which bounds how far its k
        nearest are. Then all queries walk the tree together: a child is visited by those whose
        bound does not rule it out, so a leaf is compared once, with all that still need it.
        """
        queries = queries.astype(np.float64)
        best = Best(query_ids, k)
        norms = (queries**2).sum(axis=1) + top**2
        home = np.full(len(queries), -1)

        def distances(node: int, who: np.ndarray) -> np.ndarray:
            v = self.vantage[node]
            return np.sqrt(np.maximum(0, norms[who] - 2 * products(queries[who], self.vectors[v : v + 1])[:, 0]))

        def compare(node: int, who: np.ndarray) -> None:
            lo, hi = self.first[node], self.last[node]
            best.add(who, queries[who], self.vectors[lo:hi], self.ids[lo:hi])

        def settle(node: int, who: np.ndarray) -> None:
            while len(who) and self.vantage[node] >= 0:
                _, b, c, _ = self.ranges[node]
                near = distances(node, who) <= (b + c) / 2
                settle(int(self.far_child[node]), who[~near])
                node, who = node + 1, who[near]
            if len(who):
                home[who] = node
                compare(node, who)

        def visit(node: int, who: np.ndarray) -> None:
            if self.vantage[node] < 0:
                who = who[home[who] != node]
                if len(who):
                    compare(node, who)
                return
            distance = distances(node, who)
            a, b, c, d = self.ranges[node]
            for child, low, high in ((node + 1, a, b), (int(self.far_child[node]), c, d)):
                worst = np.sqrt(np.maximum(0, norms[who] - 2 * best.worst(who)))
                # A hair is added so that rounding cannot lose a tie.
                near = np.maximum(low - distance, distance - high) <= factor * worst + 1e-9
                if near.any():
                    visit(child, who[near])

        if len(self.ids) and len(queries):
            settle(0, np.arange(len(queries)))
            visit(0, np.arange(len(queries)))
        return best


class Best:
    """The k best (score, id) of each query so far; larger scores first, then smaller ids."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.scores = np.full((len(query_ids), k), -np.inf)
        self.ids = np.full((len(query_ids), k), np.iinfo(np.int64).max)

    def worst(self, who: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(self.scores[who, -1]), self.scores[who, -1], -1e300)

    def add(self, who: np.ndarray, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Takes over what is better; a fast product finds what may be, the exact one decides."""
        rough = queries @ vectors.T
        hair = 1e-9 * (1 + np.abs(rough).max(initial=0.0))
        q, v = np.nonzero((rough >= self.worst(who)[:, None] - hair) & (ids[None, :] != self.query_ids[who, None]))
        if not len(q):
            return
        exact = np.zeros(len(q))
        for i in range(vectors.shape[1]):
            exact += queries[q, i] * vectors[v, i]
        rows, count = np.unique(q, return_counts=True)
        place = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
        line = np.repeat(np.arange(len(rows)), count)
        scores = np.full((len(rows), self.k + int(count.max())), -np.inf)
        names = np.full(scores.shape, np.iinfo(np.int64).max)
        scores[:, : self.k], names[:, : self.k] = self.scores[who[rows]], self.ids[who[rows]]
        scores[line, self.k + place], names[line, self.k + place] = exact, ids[v]
        order = np.lexsort((names, -scores), axis=1)[:, : self.k]
        self.scores[who[rows]] = np.take_along_axis(scores, order, axis=1)
        self.ids[who[rows]] = np.take_along_axis(names, order, axis=1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, i = np.nonzero(np.isfinite(self.scores))
        return self.query_ids[q], self.ids[q, i], self.scores[q, i]


@dataclass(frozen=True)
class VpSearch:
    """k: neighbours. factor: of pruning, 1 is exact. shard, block: vectors of a tree and of a query
    block, about. leaf: vectors that are compared one by one."""

    k: int = 20
    factor: float = 1.0
    shard: int = 4096
    block: int = 4096
    leaf: int = 128

    def usable(self, vectors: DataFrame) -> DataFrame:
        """(vec_id, vector) of the rows that take part."""
        v = F.col("vector")
        fine = vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vector")
        ).filter(
            v.isNotNull() & F.col("vec_id").isNotNull()
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0)
        )
        length = fine.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        return fine.filter(F.size("vector") == (length["n"] if length else 0))

    def search(self, vectors: DataFrame, is_query: Column | str) -> DataFrame:
        """query_id, rank, vec_id, score: the nearest other rows of each row that is_query marks."""
        good = stored(self.usable(vectors), "vectors")
        square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        n, most = good.agg(F.count(F.lit(1)), F.max(square)).first()
        shards = max(1, -(-n // self.shard))
        top = float(np.sqrt(most or 1.0) * (1 + 1e-12))
        k, factor, leaf = self.k, self.factor, self.leaf

        def matrix(column: pa.ChunkedArray) -> np.ndarray:
            flat = column.combine_chunks()
            return flat.flatten().to_numpy().reshape(len(flat), -1)

        def build(group: pa.Table) -> pa.Table:
            tree = VpTree.build(group["vec_id"].to_numpy(), matrix(group["vector"]), top, leaf)
            return pa.table({"shard": group["shard"][:1], "tree": pa.array([tree.dump()], pa.binary())})

        def pack(group: pa.Table) -> pa.Table:
            ids = group["vec_id"].to_numpy().astype("<i8").tobytes()
            blob = pa.array([matrix(group["vector"]).astype("<f4").tobytes()], pa.binary())
            return pa.table({"block": group["block"][:1], "query_ids": pa.array([ids], pa.binary()), "queries": blob})

        number = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int")
        trees = good.withColumn("shard", number).groupBy("shard").applyInArrow(build, "shard int, tree binary")
        asked = good.filter(is_query)
        blocks = max(1, -(-asked.count() // self.block))
        number = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
        packed = (
            asked.withColumn("block", number)
            .groupBy("block")
            .applyInArrow(pack, "block int, query_ids binary, queries binary")
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        )

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids = np.frombuffer(batch.column("query_ids")[i].as_buffer(), "<i8")
                    queries = np.frombuffer(batch.column("queries")[i].as_buffer(), "<f4").reshape(len(ids), -1)
                    tree = VpTree.load(batch.column("tree")[i].as_buffer())
                    found = tree.search(ids, queries, k, top, factor).rows()
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

        pairs = stored(trees, "vp-trees").join(stored(packed, "vp-queries"), "shard")
        rows = pairs.select("query_ids", "queries", "tree").mapInArrow(search, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return (
            rows.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score")
        )
