"""Consolidating pairwise matches into groups: union-find on a two-dimensional grid of vertex blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowgrid.session import hot_keys, look_up, materialise

#: Rows and columns of the finest grid; its cells are counted and their counts (at most GRID * (GRID + 1) / 2) planned with.
GRID = 128
#: Edges that one block should hold; a block with more than twice as many is split.
BLOCK_EDGES = 1_000_000
#: Vertices that may look up the same representative in one task; those of a larger group are spread over copies of it.
HOT_VERTICES = 250_000


def _lists(col: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the strings in byte order of their values, and those values."""
    enc = pc.dictionary_encode(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col)
    order = pc.sort_indices(enc.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[enc.indices.to_numpy(zero_copy_only=False)], enc.dictionary.take(order)


def local_roots(u: pa.ChunkedArray, v: pa.ChunkedArray) -> tuple[pa.Array, pa.Array]:
    """Every distinct vertex of the edges, and the smallest vertex (byte order) that these edges join it with."""
    n = len(u)
    codes, names = _lists(pa.chunked_array([*u.chunks, *v.chunks], pa.string()))
    a, b = codes[:n], codes[n:]
    real = a != b
    pairs = np.unique(np.stack([np.minimum(a[real], b[real]), np.maximum(a[real], b[real])], 1), axis=0) if real.any() else np.empty((0, 2), np.int64)
    parent = list(range(len(names)))
    for x, y in pairs.tolist():
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    root = np.array(parent, np.int64)
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return names, names.take(pa.array(root))
        root = up


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held)
        names, roots = local_roots(t["u"], t["v"])
        for at in range(0, len(names), 50_000):
            yield pa.RecordBatch.from_arrays([names.slice(at, 50_000), roots.slice(at, 50_000)], names=["v", "r"])


def _cell(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(GRID)).cast("int")


def _blocks(edges: DataFrame, block_edges: int) -> tuple[DataFrame, int]:
    """Edges with ``pid``, the block (or part of a hot block) that solves them, and the number of blocks."""
    counts = edges.groupBy(_cell(F.col("u")).alias("i"), _cell(F.col("v")).alias("j")).count().collect()
    total, side = sum(r["count"] for r in counts), 1
    while side < GRID and total > block_edges * side * (side + 1) // 2:
        side *= 2
    sums: dict[tuple[int, int], int] = {}
    for r in counts:
        key = (min(r.i % side, r.j % side), max(r.i % side, r.j % side))
        sums[key] = sums.get(key, 0) + r["count"]
    plan, base = [], 0
    for (i, j), n in sorted(sums.items()):
        parts = max(1, -(-n // (2 * block_edges)))
        plan.append((i * side + j, base, parts))
        base += parts
    i, j = F.pmod(_cell(F.col("u")), F.lit(side)), F.pmod(_cell(F.col("v")), F.lit(side))
    key = (F.least(i, j) * side + F.greatest(i, j)).cast("int")
    if base <= 1:
        return edges.withColumn("pid", F.lit(0)), 1
    # At most GRID * (GRID + 1) / 2 rows, whatever the input: safe to send to every executor.
    table = edges.sparkSession.createDataFrame(plan, "block int, base int, parts int")
    placed = edges.withColumn("block", key).join(F.broadcast(table), ["block"])
    return placed.select("u", "v", (F.col("base") + F.pmod(F.xxhash64("u", "v"), F.col("parts"))).cast("int").alias("pid")), base


def connected_groups(edges: DataFrame, block_edges: int = BLOCK_EDGES, hot_vertices: int = HOT_VERTICES) -> DataFrame:
    """``v, root`` for every vertex in ``edges`` (``u, v`` strings, not NULL); root is the smallest vertex reached.

    A vertex without links is given as an edge to itself. Vertices are hashed to the rows and columns of a grid;
    a task solves the edges of one block by union-find. Then each vertex compares what the blocks of its row and
    column found: the smallest representative becomes its parent, the others are linked to it, and these links
    between representatives are the edges of the next round. It ends when no block disagrees; every round leaves
    fewer vertices, and as soon as the links fit one block the next round is the last. A block that a hub makes too
    large is split over several tasks, since any part of a block may be solved by itself. Repeated, reversed and
    self pairs are harmless; an empty table gives an empty one. At the end each vertex looks up what became of
    its representative; the vertices of a giant group do that in many tasks.
    """
    maps = []
    while True:
        placed, blocks = _blocks(edges, block_edges)
        stars = placed.repartitionById(blocks, F.col("pid")).select("u", "v").mapInArrow(_solve, "v string, r string")
        if blocks == 1:
            last = materialise(stars.withColumnRenamed("r", "m"), "groups")
            maps.append(last)
            break
        merged = stars.groupBy("v").agg(F.min("r").alias("m"), F.collect_set("r").alias("_all"))
        others = F.when(F.size("_all") > 1, F.array_remove(F.col("_all"), F.col("m")))
        merged = materialise(merged.select("v", "m", others.alias("others")), "groups")
        maps.append(merged.select("v", "m"))
        edges = merged.where("others is not null").select(F.explode("others").alias("u"), F.col("m").alias("v")).distinct()
        if edges.isEmpty():
            break
    out = maps[-1].select("v", F.col("m").alias("root"))
    for level in reversed(maps[:-1]):
        hot = hot_keys(level, "m", level.count(), hot_vertices)
        out = look_up(level, "m", "v", out.select(F.col("v").alias("_at"), "root"), hot, "left").select("v", F.coalesce("root", "m").alias("root"))
    return out


def match_edges(matches: DataFrame, a: str, b: str, score: str, least: float) -> DataFrame:
    """Edges ``u, v`` of a match table: ids trimmed and lower-cased, blank and NULL ones dropped.

    A row links its two ids if both are there and its score (NULL counts as none) is at least ``least``; other
    ids come out as edges to themselves.
    """
    ids = matches.select(*[F.lower(F.regexp_replace(F.col(c), r"^[\s ]+|[\s ]+$", "")).alias(k) for c, k in ((a, "a"), (b, "b"))], F.col(score).alias("s"))
    has_a, has_b = F.coalesce(F.col("a") != "", F.lit(False)), F.coalesce(F.col("b") != "", F.lit(False))
    linked = has_a & has_b & F.coalesce((F.col("s") >= least) & ~F.isnan("s"), F.lit(False))
    pair = lambda x, y: F.struct(F.col(x).alias("u"), F.col(y).alias("v"))
    rows = F.when(linked, F.array(pair("a", "b"))).when(has_a & has_b, F.array(pair("a", "a"), pair("b", "b"))).when(has_a, F.array(pair("a", "a"))).when(has_b, F.array(pair("b", "b")))
    return ids.select(F.inline(rows))
