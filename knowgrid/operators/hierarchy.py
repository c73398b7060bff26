"""Parent-child links to full hierarchies: subtree sizes upward, sibling preorder ranges downward, nested sets.

Neither pass goes level by level: each works with pointers that double their reach every round, so the rounds are
log2 of the depth and a row never carries more than a few numbers. Ancestors and descendants come out of the finished
ranges, by one sweep over the preorder numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowgrid.session import discard, hot_keys, look_up, materialise

#: Buckets into which the children of one parent are split, at least, and nodes that one bucket may hold at most.
SIBLING_BUCKETS, BUCKET_NODES = 64, 200_000
#: Nodes that may look up the same one in one task; those of a node with more are spread over several copies of it.
HOT_NODES = 100_000
#: Preorder numbers that one task of the sweep covers.
SWEEP_NODES = 100_000


def subtree_sizes(links: DataFrame, hot_nodes: int = HOT_NODES) -> tuple[DataFrame, list[DataFrame | None]]:
    """``node, parent, size, ups`` of the nodes that a root is above, from ``node, parent`` (distinct; parent NULL or one
    of them); and the hot nodes of every round.

    Before round k a node knows its 2^k-th ancestor (``ups`` lists those of all rounds) and how many nodes are less
    than 2^k below it. It adds its count to that ancestor's and takes that ancestor's pointer. Whoever has no such
    ancestor is done. Depths leave no gaps, so when a round finishes nobody, all that is unprocessed is on a circle
    or below one.
    """
    start = links.select("node", "parent", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size"), F.array_compact(F.array("parent")).alias("ups"))
    now = materialise(start, "tree")
    n, open_, rounds = now.count(), now.where("up is not null").count(), []
    while open_:
        waiting = now.where("up is not null")
        rounds.append(hot_keys(waiting, "up", n, hot_nodes))
        more = waiting.groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("_more"))
        step = look_up(waiting, "up", "node", now.select(F.col("node").alias("_at"), F.col("up").alias("_next")), rounds[-1])
        step = step.select("node", "parent", F.col("_next").alias("up"), "size", F.when(F.col("_next").isNull(), F.col("ups")).otherwise(F.concat("ups", F.array("_next"))).alias("ups"))
        step = step.unionByName(now.where("up is null")).join(more, ["node"], "left")
        last, now = now, materialise(step.select("node", "parent", "up", (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"), "ups"), "tree")
        discard(last)
        still = now.where("up is not null").count()
        if still == open_:
            break
        open_ = still
    return now.where("up is null").select("node", "parent", "size", "ups"), rounds


def preorder_ranges(sized: DataFrame, rounds: list[DataFrame | None], buckets: int = SIBLING_BUCKETS) -> DataFrame:
    """``node, parent, size, lft``: the preorder number, so that ``[lft, lft + size)`` holds exactly the subtree.

    A node's offset within its parent is one plus the sizes of the siblings before it. Siblings are ordered by
    (bucket, node): a prefix sum within each bucket and one over the bucket totals; roots are each other's
    siblings, so all trees together have the numbers from 1 on without a gap. Offsets are added up downward with
    the pointers of ``subtree_sizes``: a node adds what its 2^k-th ancestor has.
    """
    kids = sized.select("node", "parent", "size", "ups", F.coalesce("parent", F.lit("")).alias("_p"), F.pmod(F.xxhash64("node"), F.lit(buckets)).alias("_b"))
    totals = kids.groupBy("_p", "_b").agg(F.sum("size").alias("_t"))
    before = totals.withColumn("_o", F.sum("_t").over(Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_t")
    inner = kids.withColumn("_i", F.sum("size").over(Window.partitionBy("_p", "_b").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.lit(1) + F.coalesce("_o", F.lit(0)) + F.coalesce("_i", F.lit(0))
    now = materialise(inner.join(before, ["_p", "_b"]).select("node", "parent", "size", "ups", own.cast("long").alias("lft")), "ranges")
    for k, hot in enumerate(rounds):
        waiting, above = now.where(F.size("ups") > k).withColumn("up", F.get("ups", F.lit(k))), now.select(F.col("node").alias("_at"), F.col("lft").alias("_above"))
        step = look_up(waiting, "up", "node", above, hot).withColumn("lft", F.col("lft") + F.col("_above")).drop("up", "_above")
        last, now = now, materialise(step.unionByName(now.where(F.size("ups") <= k)), "ranges")
        discard(last)
    return now.drop("ups")


def _sweep(ranged: DataFrame, emit: Callable, ddl: str, nodes: int = SWEEP_NODES) -> DataFrame:
    """One pass over all ranges in order of ``lft``, in blocks of equal length; ``emit(stack, node, lft, size)`` gives a
    row's results, ``stack`` being its ancestors from the root.

    A block begins with copies of the ranges that reach into it, which are the ancestors of its first node; so no
    node is in more than one task with all its descendants, however many these are.
    """
    block = lambda c: F.floor(c / nodes).cast("long")
    own = ranged.select(block(F.col("lft")).alias("b"), "lft", "size", "node", F.lit(True).alias("own"))
    last = block(F.col("lft") + F.col("size") - 1)
    reach = ranged.where(last > block(F.col("lft"))).select(F.explode(F.sequence(block(F.col("lft")) + 1, last)).alias("b"), "lft", "size", "node", F.lit(False).alias("own"))
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ends, stack = None, [], []
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for b, lft, size, node, mine in zip(*(c.to_pylist() for c in batch.columns)):
                if b != at:
                    at, ends, stack = b, [], []
                while ends and ends[-1] <= lft:
                    ends.pop()
                    stack.pop()
                if mine:
                    for row in emit(stack, node, lft, size):
                        for c, v in zip(out, row):
                            c.append(v)
                ends.append(lft + size)
                stack.append(node)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return own.unionByName(reach).repartition("b").sortWithinPartitions("b", "lft").mapInArrow(run, ddl)


def _named(links: DataFrame) -> DataFrame:
    """Links with the parents that are nodes themselves. A parent named by many is looked up in a table without them."""
    named = links.where("node is not null").select("node", F.when(F.col("parent") != "", F.col("parent")).alias("parent"))
    parents = named.where("parent is not null").select("parent").distinct()
    real = parents.join(named.select(F.col("node").alias("parent")), ["parent"], "left_semi")
    # Both sides hold each name once, so only what is no node has to be told apart: as a rule next to nothing.
    lost = materialise(parents.join(real, ["parent"], "left_anti").withColumn("_lost", F.lit(True)), "lost")
    told = named.where("parent is not null").join(lost, ["parent"], "left").select("node", F.when(F.col("_lost").isNull(), F.col("parent")).alias("parent"))
    return told.unionByName(named.where("parent is null"))


def ranges(links: DataFrame, hot_nodes: int = HOT_NODES) -> tuple[DataFrame, DataFrame]:
    """``node, parent, size, lft`` of the nodes in trees, and ``node, parent`` of those on or below circles."""
    named = materialise(_named(links), "links")
    sized, rounds = subtree_sizes(named, hot_nodes)
    buckets = max(SIBLING_BUCKETS, named.count() // BUCKET_NODES)
    ranged = preorder_ranges(sized, rounds, buckets)
    return ranged, named.join(ranged.select("node"), ["node"], "left_anti")


def hierarchy(links: DataFrame, sep: str = ">", hot_nodes: int = HOT_NODES, sweep_nodes: int = SWEEP_NODES) -> DataFrame:
    """``node, parent, root_node, lvl, node_path, lft, size, in_circle`` for every row of ``links`` (``node, parent``).

    Nodes are distinct, NULL ones are left out; a parent that is no node counts as none. Root, level and path are read
    from the ranges around a node's number. Those that the two passes never reach have no range: they are on a circle
    or below one and get root 'cycle', level -1 and an empty path. A node that is its own parent is a circle of
    one. Ranges of different trees don't overlap. An empty table gives an empty one.
    """
    ranged, lost = ranges(links, hot_nodes)

    def line(stack: list[str], node: str, lft: int, size: int) -> list[tuple]:
        return [(node, stack[-1] if stack else None, stack[0] if stack else node, len(stack), sep.join([*stack, node]), lft, size)]

    done = _sweep(ranged, line, "node string, parent string, root_node string, lvl int, node_path string, lft long, size long", sweep_nodes)
    none: Column = F.lit(None).cast("bigint")
    circles = lost.select("node", "parent", F.lit("cycle").alias("root_node"), F.lit(-1).alias("lvl"), F.lit("").alias("node_path"), none.alias("lft"), none.alias("size"), F.lit(True).alias("in_circle"))
    return done.withColumn("in_circle", F.lit(False)).unionByName(circles)


def descendants(tree: DataFrame, sweep_nodes: int = SWEEP_NODES) -> DataFrame:
    """``ancestor, node`` for every pair with the ancestor strictly above, from the ranges of a ``hierarchy``: a node's
    ancestors are the ranges around its number."""
    return _sweep(tree.where("not in_circle"), lambda stack, node, lft, size: [(a, node) for a in stack], "ancestor string, node string", sweep_nodes)
