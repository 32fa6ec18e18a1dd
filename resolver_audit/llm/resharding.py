"""Resharding by minimum-cost flow.

Documents lie in old shards. From the bytes of the old shards and the capacities of the new
ones, a minimum-cost flow gives how many bytes each old shard hands to each new one, moving
as few bytes as possible (staying costs nothing, moving costs one a byte). Old shards are
cut into blocks of text hashes, and each flow takes a run of blocks; only runs' edges are cut
finer. Then only the shards that gain or lose blocks are rewritten, without a shuffle: a row
finds its new shard in small tables by block, and only rows of the few blocks at an edge are sorted.

Equal texts stay together. Texts that make up a large share of a shard are placed before the flow
is solved, at home where there is room; only what no shard has room for is cut by document.

Defined results: a null text has size 1 and the checksum of no bytes; null and empty texts are
equal. Repeated rows are placed one by one. A null doc_id is placed like others. Other columns
are carried along; the names of the shards' folders and of slot are given and must be free (the
query takes free ones). An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resolver_audit.llm.storage import stored


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Bytes from each supply to each capacity at least total cost; cost(i, j) of one byte.

    Successive shortest paths with potentials. The network has as many nodes as there are
    shards. Sums must be equal.
    """
    if sum(supply) != sum(capacity):
        raise ValueError("supply and capacity differ")
    m, n = len(supply), len(capacity)
    source, sink = m + n, m + n + 1
    edges: list[list[int]] = []  # to, room, cost
    out: list[list[int]] = [[] for _ in range(m + n + 2)]

    def link(a: int, b: int, room: int, price: int) -> None:
        out[a].append(len(edges))
        edges.append([b, room, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])

    for i, s in enumerate(supply):
        link(source, i, s, 0)
        for j in range(n):
            link(i, m + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        link(m + j, sink, c, 0)
    potential = [0] * len(out)
    left = sum(supply)
    while left:
        distance, by, queue = {source: 0}, {}, [(0, source)]
        while queue:
            d, a = heappop(queue)
            if d > distance[a]:
                continue
            for e in out[a]:
                b, room, price = edges[e]
                there = d + price + potential[a] - potential[b]
                if room and there < distance.get(b, there + 1):
                    distance[b], by[b] = there, e
                    heappush(queue, (there, b))
        far = max(distance.values())
        potential = [p + distance.get(v, far) for v, p in enumerate(potential)]
        path, v = [], sink
        while v != source:
            path.append(by[v])
            v = edges[by[v] ^ 1][0]
        push = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= push
            edges[e ^ 1][1] += push
        left -= push
    flows = {}
    for i in range(m):
        for e in out[i]:
            b, _, _ = edges[e]
            if m <= b < m + n and edges[e ^ 1][1]:
                flows[i, b - m] = edges[e ^ 1][1]
    return flows


#: Blocks by text, finer by text, and by document.
KEYS = ["old", "b0", "b1", "b2"]

#: In place of the block by document: a block at an edge whose texts are not cut.
BY_TEXT = -1


@dataclass
class Route:
    """New shards by whole text, by block of each cut, and by run in the blocks at edges: tables as
    large as old and new shards times blocks. changed: shards that a row leaves or comes to."""

    blocks: int
    placed: dict[int, int]
    cut: list[int]
    settled: tuple[list, list, list] = field(default_factory=lambda: ([], [], []))
    edges: list = field(default_factory=list)
    changed: set[int] = field(default_factory=set)

    def leveled(self, rows: DataFrame) -> DataFrame:
        """Adds the blocks of each cut. Texts that are cut have blocks of their own."""
        h, n = F.col("h"), F.lit(self.blocks)
        finer = F.pmod(F.xxhash64("h"), n)
        finer = F.when(h.isin(self.cut), n.cast("long")).otherwise(finer) if self.cut else finer
        return rows.withColumns(
            {"b0": F.pmod(h, n).cast("int"), "b1": finer.cast("int"), "b2": F.pmod(F.col("d"), n).cast("int")}
        )

    def whole(self, rows: DataFrame) -> DataFrame:
        return rows.sparkSession.createDataFrame([*self.placed.items()], "h long, whole int")

    def apply(self, rows: DataFrame) -> DataFrame:
        """Rows with old, h, d and size get their new shard; only rows at edges are shuffled."""
        spark = rows.sparkSession
        found = self.leveled(rows).join(F.broadcast(self.whole(rows)), "h", "left")
        for depth, known in enumerate(self.settled):
            keys = KEYS[: depth + 2]
            schema = ", ".join(f"{k} int" for k in keys)
            table = spark.createDataFrame(known, f"{schema}, s{depth} int")
            found = found.join(F.broadcast(table), keys, "left")
        found = found.withColumn("shard", F.coalesce("whole", "s0", "s1", "s2"))
        out = found.filter("shard IS NOT NULL").select(*rows.columns, "shard")
        if not self.edges:
            return out
        schema = ", ".join(f"{k} int" for k in ["old", "b0", "b1", "edge"])
        ends = spark.createDataFrame(self.edges, f"{schema}, ends array<long>, shards array<int>")
        by_text = F.col("edge") == BY_TEXT
        last = found.filter("shard IS NULL").withColumn(
            "edge", F.when(F.col("b1") < self.blocks, F.lit(BY_TEXT)).otherwise(F.col("b2"))
        )
        last = last.join(F.broadcast(ends), ["old", "b0", "b1", "edge"]).withColumn("one", F.when(~by_text, F.col("d")))
        # A text, or a document of a text that is cut, goes where its middle falls.
        block = ["old", "b0", "b1", "edge"]
        upto = Window.partitionBy(*block).orderBy("h", "one").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        own = Window.partitionBy(*block, "h", "one")
        middle = F.sum("size").over(upto) - F.sum("size").over(own) / 2
        run = F.size(F.filter("ends", lambda e: e < F.col("middle")))
        shard = F.get("shards", F.least(run, F.size("shards") - 1))
        return out.union(last.withColumn("middle", middle).select(*rows.columns, shard.alias("shard")))


@dataclass(frozen=True)
class Resharding:
    """shards: new ones, 0 to shards - 1. blocks: of an old shard, and of each finer cut.
    cells: parts of a shard within which a plan numbers documents. whole: texts whose rows take more
    than this share of a shard (shards / whole texts at most) are placed one by one."""

    shards: int = 16
    blocks: int = 512
    cells: int = 256
    whole: float = 0.01

    def measured(self, documents: DataFrame, old: Column) -> DataFrame:
        """(old, doc_id, size, text_crc32, h, d): what placement needs; texts stay where they are."""
        text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
        doc_id = F.col("doc_id").cast("long")
        return documents.select(
            old.cast("int").alias("old"), doc_id.alias("doc_id"), text_size().alias("size"),
            F.crc32(text).alias("text_crc32"), text_hash().alias("h"), F.xxhash64(doc_id, text_hash()).alias("d"),
        )

    def capacities(self, total: int) -> list[int]:
        return [total * (j + 1) // self.shards - total * j // self.shards for j in range(self.shards)]

    def heavy(self, rows: DataFrame, supply: dict[int, int]) -> tuple[dict[int, int], list[int], list[int], set]:
        """Large texts that are placed whole, with their shard; those to be cut; the room left; moves made.

        Takes what is placed from the supply.
        """
        room = self.capacities(sum(supply.values()))
        least = self.whole * sum(supply.values()) / self.shards
        sizes = {
            r["h"]: r["size"]
            for r in rows.groupBy("h").agg(F.sum("size").alias("size")).filter(F.col("size") > least).collect()
        }
        parts: dict[int, dict[int, int]] = defaultdict(dict)
        known = rows.sparkSession.createDataFrame([(h,) for h in sizes], "h long")
        found = rows.join(F.broadcast(known), "h", "left_semi").groupBy("h", "old").agg(F.sum("size").alias("size"))
        for r in found.collect():
            parts[r["h"]][r["old"]] = r["size"]
        placed: dict[int, int] = {}
        moves: set[tuple[int, int]] = set()

        def place(h: int, j: int) -> None:
            placed[h] = j
            room[j] -= sizes[h]
            for old, size in parts[h].items():
                supply[old] -= size
                if old != j:
                    moves.add((old, j))

        order = sorted(sizes, key=lambda h: (-sizes[h], h))
        for h in order:
            home = max(parts[h], key=lambda o: (parts[h][o], -o))
            if home < self.shards and room[home] >= sizes[h]:
                place(h, home)
        for h in order:
            fits = [j for j in range(self.shards) if room[j] >= sizes[h]]
            if h not in placed and fits:
                # Where the shard's own rows leave most room.
                place(h, max(fits, key=lambda j: (room[j] - supply.get(j, 0), -j)))
        return placed, [h for h in order if h not in placed], room, moves

    def route(self, rows: DataFrame) -> Route:
        """Where the rows of a stored measured table go."""
        sums = {r["old"]: r["size"] for r in rows.groupBy("old").agg(F.sum("size").alias("size")).collect()}
        olds = sorted(sums)
        placed, cut, room, moves = self.heavy(rows, sums)
        flows = min_cost_flow([sums[o] for o in olds], room, lambda i, j: int(olds[i] != j))
        route = Route(self.blocks, placed, cut)
        moves |= {(olds[i], j) for i, j in flows if olds[i] != j}
        route.changed.update(shard for move in moves for shard in move)
        # Cuts of an old shard's bytes, in the order of its blocks: where one new shard's run ends.
        cuts: dict[tuple, list[tuple[int, int]]] = {}
        for i, o in enumerate(olds):
            at, runs = 0, []
            for j in range(self.shards):
                if flows.get((i, j)):
                    at += flows[i, j]
                    runs.append((at, j))
            cuts[(o,)] = runs
        open_ = route.leveled(rows).join(F.broadcast(route.whole(rows)), "h", "left_anti")
        for depth in range(3):
            keys = KEYS[: depth + 2]
            # One number for each block of the few runs that are still open.
            sizes = open_.groupBy(*keys).agg(F.sum("size").alias("size")).collect()
            of: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
            for r in sizes:
                of[tuple(r[k] for k in keys[:-1])].append((r[keys[-1]], r["size"]))
            left = {}
            for prefix, blocks in of.items():
                at = 0
                for block, size in sorted(blocks):
                    runs = [(end - at, j) for end, j in cuts[prefix] if end > at] or [(size, cuts[prefix][-1][1])]
                    at += size
                    if runs[0][0] >= size or len(runs) == 1:
                        route.settled[depth].append((*prefix, block, runs[0][1]))
                    elif depth == 2 or (depth == 1 and block < self.blocks):
                        edge = (*prefix, block) if depth == 2 else (*prefix, block, BY_TEXT)
                        route.edges.append((*edge, [e for e, _ in runs], [j for _, j in runs]))
                    else:
                        left[(*prefix, block)] = runs
            if not left:
                break
            schema = ", ".join(f"{k} int" for k in keys)
            open_ = open_.join(F.broadcast(rows.sparkSession.createDataFrame([*left], schema)), keys, "left_semi")
            cuts = left
        return route

    def placed(self, rows: DataFrame) -> DataFrame:
        """The rows of a stored measured table with their new shard."""
        return self.route(rows).apply(rows)

    def slots(self, placed: DataFrame) -> DataFrame:
        """Adds slot: a document's number in its shard, gapless from 0. Shards are numbered in cells."""
        celled = placed.withColumn("cell", F.pmod("d", F.lit(self.cells)).cast("int"))
        before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            celled.groupBy("shard", "cell")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        )
        number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("d", "doc_id"))
        return (
            celled.withColumn("number", number)
            .join(F.broadcast(offsets), ["shard", "cell"])
            .withColumn("slot", F.col("offset") + F.col("number") - 1)
        )

    def plan(self, documents: DataFrame, old: Column) -> DataFrame:
        """(old, doc_id, size, text_crc32, h, d, shard, slot): where every document goes."""
        rows = stored(self.measured(documents, old), "reshard-rows")
        placed = stored(self.placed(rows), "reshard-placed")
        return self.slots(placed)

    def rewrite(self, old_folder: str, plan: DataFrame, new_folder: str) -> list[int]:
        """Writes the shards that change, from Parquet files below old_folder/shard=N, to new_folder/shard=N.

        Returns the shards that are written; the files of all others stay as they are. Texts
        come by doc_id and text hash, so rows repeated in both are written as often as they were.
        For a plan of documents that are not at hand as shards; `reshard` needs no join.
        """
        moved = plan.filter("old != shard")
        changed = sorted(
            r[0] for r in moved.select("old").union(moved.select("shard")).distinct().collect() if r[0] is not None
        )
        spark = plan.sparkSession
        source = spark.read.option("basePath", old_folder).parquet(f"{old_folder}/shard=*")
        given = moved.select(F.col("old").alias("shard")).union(moved.select("shard")).distinct()
        # The documents' own columns travel in one, so they may have any names.
        texts = source.select(
            F.struct(*[c for c in source.columns if c != "shard"]).alias("row"),
            F.col("shard").alias("from_shard"), F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"),
        )
        same = Window.partitionBy("doc_id", "h").orderBy("slot")
        copies = Window.partitionBy("doc_id", "h").orderBy("from_shard")
        target = plan.withColumn("copy", F.row_number().over(same)).select(
            F.col("doc_id").alias("p_id"), F.col("h").alias("p_h"), F.col("copy").alias("p_copy"), "shard"
        )
        target = target.join(F.broadcast(given), "shard", "left_semi")
        numbered = texts.withColumn("copy", F.row_number().over(copies))
        on = (
            F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("h") == F.col("p_h")) & (F.col("copy") == F.col("p_copy"))
        )
        numbered.join(target, on).select("row.*", "shard").write.partitionBy("shard").parquet(new_folder)
        return [int(s) for s in changed if s < self.shards]

    def reshard(self, shards: DataFrame, name: str, new_folder: str, slot: str = "slot") -> DataFrame:
        """Rewrites the shards that change and returns all rows as the files then hold them.

        shards is read from Parquet folders name=N. The changed shards are written to new_folder/name=N,
        each task's rows to the few shards that its old ones hand over to. The result has the documents'
        columns, name and slot (under the name given): the row's place in its shard, in the order of its files.
        """
        spark = shards.sparkSession
        schema = shards.schema
        row = F.struct(*[F.col(f"`{c}`") for c in shards.columns if c != name]).alias("row")
        # A row's place in its file tells repeated rows apart where a text has to be cut.
        place = F.xxhash64("doc_id", text_hash(), "_metadata.row_index")
        sizes = [F.col(f"`{name}`").alias("old"), text_size().alias("size"), text_hash().alias("h"), place.alias("d")]
        route = self.route(stored(shards.select(*sizes), "reshard-sizes"))
        # Every move has both its ends in changed, so no other shard holds or receives a moved row.
        stays = ~F.col(f"`{name}`").isin(sorted(route.changed)) if route.changed else F.lit(True)
        moved = route.apply(shards.filter(~stays).select(row, *sizes))
        moved.select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(new_folder)
        new = spark.read.schema(schema).parquet(new_folder)
        return in_order(shards, name, stays, slot).unionByName(in_order(new, name, F.lit(True), slot))


def text_hash() -> Column:
    """A null text is an empty one here too: equal texts share a hash."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def text_size() -> Column:
    return F.octet_length(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long") + 1


def write_shards(documents: DataFrame, shard: Column, name: str, folder: str) -> DataFrame:
    """The documents written to Parquet folders name=N, and read again."""
    frame = documents.withColumn(name, shard.cast("int"))
    frame.write.partitionBy(name).parquet(folder)
    return documents.sparkSession.read.schema(frame.schema).parquet(folder)


def in_order(shards: DataFrame, name: str, which: Column, slot: str) -> DataFrame:
    """The rows of shards read from files, with slot: numbered through a shard's files by their paths."""
    row = F.struct(*[F.col(f"`{c}`") for c in shards.columns]).alias("row")
    at = shards.filter(which).select(
        row, F.col(f"`{name}`").alias("of"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("index"),
    )
    # A row for each file; stored, so that Spark knows its size and broadcasts it while it is small.
    files = at.groupBy("of", "file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("of").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    files = stored(files, "reshard-files")
    number = (F.col("before") + F.col("index")).alias(slot)
    return at.join(files, "file").select(*[F.col(f"row.`{c}`").alias(c) for c in shards.columns], number)
