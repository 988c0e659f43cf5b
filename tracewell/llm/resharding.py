"""Resharding by minimum-cost flow: near-equal shards with the fewest bytes moved.

A layout is a folder of Parquet files, a subfolder for each shard.  Old shards are
sources of their bytes and new shards take at most their capacities; a byte that stays
costs nothing and one that moves costs one.  The flow says how many bytes go from each
shard to each other one.  It is met by dealing each old shard's files, in order of their
names, to consecutive blocks: the first stays, the others go where the flow sends them.
Files of blocks that stay are left as they are, untouched.  Files of blocks that move are
written anew in their new shards.  Of a file that a border between blocks cuts each row is
dealt by itself: the largest first, to the block that still has room for it, so that what
is left over is smaller than the file's smallest rows; it is written anew as well.
A list of files with their shards and first slots (`manifest`) is the new layout.

No step shuffles texts but those of cut files, of which there are fewer than one for each
pair of shards: the others are read and written in splits of bytes.  The driver holds
a row for each file, as Spark itself does for any table it reads, and the flow.

Defined results: a null text has no bytes (size 1) and the checksum 0; null sources are
one old shard; rows are dealt one by one, so rows with equal texts or doc_ids, or without an
id, are no special case and may be in different shards; a row that is larger than a shard's
capacity goes to the block with the most room; an empty table has no shards.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import drop, new_path, written


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Amounts sent from each source to each sink: all supply, within capacities, at the least cost (successive shortest paths with potentials)."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # edges: to, room, cost, place of the reverse edge

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, amount in enumerate(supply):
        edge(source, i, amount, 0)
    for i in range(n):
        for j in range(m):
            edge(i, n + j, supply[i], cost[i][j])
    for j, room in enumerate(capacity):
        edge(n + j, sink, room, 0)
    left, potential = sum(supply), [0] * (n + m + 2)
    while left > 0:
        far, came = [float("inf")] * len(graph), [(-1, -1)] * len(graph)
        far[source], queue = 0, [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                reach = d + price + potential[a] - potential[b]
                if room > 0 and reach < far[b]:
                    far[b], came[b] = reach, (a, k)
                    heapq.heappush(queue, (reach, b))
        if far[sink] == float("inf"):
            raise ValueError("the capacities hold less than the supply")
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, far, strict=True)]
        amount, b = left, sink
        while b != source:
            a, k = came[b]
            amount, b = min(amount, graph[a][k][1]), a
        b = sink
        while b != source:
            a, k = came[b]
            graph[a][k][1] -= amount
            graph[b][graph[a][k][3]][1] += amount
            b = a
        left -= amount
    return [[graph[n + j][next(k for k, e in enumerate(graph[n + j]) if e[0] == i)][1] for j in range(m)] for i in range(n)]


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


@dataclass
class File:
    """A file of a layout."""

    shard: int
    name: str
    size: int  # of the texts in it, with one for each row
    rows: int


def _size(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def write_layout(documents: DataFrame, path: str, shard: Column, doc_id: str = "doc_id", text: str = "text") -> None:
    """Documents as a layout: each task writes a file for each shard of its rows."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _size(text).alias("size"), shard.cast("int").alias("shard"))
    rows.write.option("compression", "zstd").partitionBy("shard").parquet(path)


def _read(spark: SparkSession, paths: list[str], doc_id_type: str) -> DataFrame:
    return spark.read.schema(f"doc_id {doc_id_type}, text string, size long").parquet(*paths)


def _file(path: Column) -> Column:
    """Subfolder and name of a file: names repeat between the shards that one task writes."""
    return F.array_join(F.slice(F.split(path, "/"), -2, 2), "/")


def files_of(spark: SparkSession, path: str) -> list[File]:
    """The files of a layout, in order; only the sizes are read."""
    rows = spark.read.schema("size long, shard int").parquet(path)
    found = rows.groupBy("shard", _file(F.col("_metadata.file_path")).alias("name")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    return [File(r["shard"], r["name"], r["size"], r["rows"]) for r in found.orderBy("shard", "name").collect()]


@dataclass
class Plan:
    """How a layout becomes the next: the flow, files that stay, files that move whole and their shards, and files that are cut, with the shards and bytes of their parts."""

    flow: list[list[int]]
    stay: list[File] = field(default_factory=list)
    move: list[tuple[File, int]] = field(default_factory=list)
    cut: list[tuple[File, list[tuple[int, int]]]] = field(default_factory=list)


def plan(files: list[File], shards: int, capacities: list[int] | None = None) -> Plan:
    olds = max([shards, *(f.shard + 1 for f in files)])
    supply = [sum(f.size for f in files if f.shard == i) for i in range(olds)]
    capacities = capacities or equal_capacities(sum(supply), shards)
    out = Plan(min_cost_flow(supply, capacities, [[int(i != j) for j in range(shards)] for i in range(olds)]))
    for i in range(olds):
        blocks = [[j, out.flow[i][j]] for j in sorted(range(shards), key=lambda j, i=i: (j != i, j)) if out.flow[i][j]]
        for f in (f for f in files if f.shard == i):
            rest, parts = f.size, []
            while rest:
                part = min(rest, blocks[0][1])
                parts.append((blocks[0][0], part))
                rest, blocks[0][1] = rest - part, blocks[0][1] - part
                if not blocks[0][1]:
                    blocks.pop(0)
            if len(parts) > 1:
                out.cut.append((f, parts))
            elif parts[0][0] == i:
                out.stay.append(f)
            else:
                out.move.append((f, parts[0][0]))
    return out


def _dealt(rows: DataFrame, parts: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """name, row and shard of the rows (name, row, size) of cut files, each file in one task."""

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        heap = [(-room, j) for j, room in parts[group["name"].iloc[0]]]
        heapq.heapify(heap)
        group, shards = group.sort_values(["size", "row"], ascending=[False, True]), []
        for size in group["size"].tolist():
            room, j = heap[0]
            shards.append(j)
            heapq.heapreplace(heap, (room + size, j))
        return group[["name", "row"]].assign(shard=pd.Series(shards, group.index, "int32"))

    return rows.groupBy("name").applyInPandas(deal, "name string, row long, shard int")


def reshard(spark: SparkSession, path: str, new: str, shards: int = 8, capacities: list[int] | None = None, doc_id_type: str = "long") -> tuple[Plan, DataFrame]:
    """Rewrite what has to move of the layout at path under new; returns the plan and the manifest: path, name and folder of each file, shard, rows and first slot."""
    done = plan(files_of(spark, path), shards, capacities)
    if done.move:
        moves = spark.createDataFrame([(f.name, to) for f, to in done.move], "name string, shard int")
        rows = _read(spark, [f"{path}/{f.name}" for f, _ in done.move], doc_id_type)
        rows = rows.withColumn("name", _file(F.col("_metadata.file_path"))).join(F.broadcast(moves), "name").drop("name")  # a row for each file
        rows.write.option("compression", "zstd").partitionBy("shard").parquet(f"{new}/moved")
    if done.cut:
        rows = _read(spark, [f"{path}/{f.name}" for f, _ in done.cut], doc_id_type)
        rows = rows.withColumns({"name": _file(F.col("_metadata.file_path")), "row": F.col("_metadata.row_index")})
        deal = written(_dealt(rows.select("name", "row", "size"), {f.name: parts for f, parts in done.cut}), "deal")
        rows.join(deal, ["name", "row"]).drop("name", "row").write.option("compression", "zstd").partitionBy("shard").parquet(f"{new}/cut")
        drop(deal)
    files = [(path, f) for f in done.stay]
    for folder, some in ((f"{new}/moved", done.move), (f"{new}/cut", done.cut)):
        files += [(folder, f) for f in files_of(spark, folder)] if some else []
    slots = [0] * shards
    rows = []
    for folder, f in sorted(files, key=lambda x: (x[1].shard, x[0], x[1].name)):
        rows.append((folder, f.name, f.shard, f.rows, slots[f.shard]))
        slots[f.shard] += f.rows
    return done, spark.createDataFrame(rows, "folder string, name string, shard int, rows long, first_slot long")


def read_shards(manifest: DataFrame, doc_id_type: str = "long") -> DataFrame:
    """doc_id, text, size, shard, slot (the place in the shard, from 0) of the layout that a manifest lists."""
    spark = manifest.sparkSession
    paths = [f"{r['folder']}/{r['name']}" for r in manifest.select("folder", "name").collect()]
    if not paths:
        return spark.createDataFrame([], f"doc_id {doc_id_type}, text string, size long, shard int, slot long")
    rows = _read(spark, paths, doc_id_type).withColumns({"__path": _tail(F.col("_metadata.file_path")), "__row": F.col("_metadata.row_index")})
    listed = manifest.select(_tail(F.concat_ws("/", "folder", "name")).alias("__path"), "shard", "first_slot")
    # A row for each file, as in Spark's own list of them.
    return rows.join(F.broadcast(listed), "__path").select("doc_id", "text", "size", "shard", (F.col("first_slot") + F.col("__row")).alias("slot"))


def _tail(path: Column) -> Column:
    """The last four parts of a path, which tell files apart whatever scheme the path is written with."""
    return F.array_join(F.slice(F.split(path, "/"), -4, 4), "/")


def digest(documents: DataFrame) -> DataFrame:
    """The columns of the query: documents laid out by source, resharded to eight equal shards, and read back from the new layout."""
    spark, kind = documents.sparkSession, documents.schema["doc_id"].dataType.simpleString()
    path = new_path(spark, "shards")
    write_layout(documents, f"{path}/old", F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")) % 8)
    _, manifest = reshard(spark, f"{path}/old", f"{path}/new", doc_id_type=kind)
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return read_shards(manifest, kind).select(
        "doc_id", "size", F.crc32(raw).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
