"""Filling fixed-capacity containers: configuration linear program over the length histogram, solved by
multiplicative weights with knapsack pricing, then rounded; items are assigned to containers where they lie."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowgrid.session import materialise, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY = 2_048
#: Share of a length's count that one step of multiplicative weights covers at most, and by how much less than the
#: best one a configuration may be worth.
STEP, SLACK = 0.5, 0.3
#: Unused share of a container that the first rounding accepts (doubled from one program to the next), and the share of
#: the whole volume below which what is left counts as the rounding's remainder.
TIGHT, REST = 0.005, 0.01
#: Items that one ranking bucket should hold.
BUCKET_ITEMS = 100_000


class Pricing:
    """Bounded knapsack over the lengths: no configuration asks for more copies than there are.

    Copies are grouped in powers of two, so that a length of any count is a few yes-or-no decisions.
    """

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int):
        self.capacity = capacity
        self.kind, self.copies = [], []
        for k, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
            n, group = min(int(count), capacity // length), 1
            while n > 0:
                self.kind.append(k)
                self.copies.append(min(group, n))
                n, group = n - group, 2 * group
        self.size = (lengths[self.kind] * np.array(self.copies)).tolist()

    def solve(self, value: np.ndarray) -> np.ndarray:
        """The most value in every room up to the capacity, by dynamic programming over rooms."""
        best = np.zeros(self.capacity + 1)
        keep = np.zeros((len(self.size), self.capacity + 1), bool)
        for i, (size, v) in enumerate(zip(self.size, (value[self.kind] * self.copies).tolist())):
            with_it, without = best[: self.capacity + 1 - size] + v, best[size:]
            np.greater(with_it, without, out=keep[i, size:])
            np.maximum(with_it, without, out=without)
        self.keep = np.ascontiguousarray(keep.T)
        return best

    def read(self, room: int, first: int | None = None) -> dict[int, int]:
        """Index -> copies of the best filling of ``room``, after one copy of ``first``."""
        out, end = {} if first is None else {first: 1}, len(self.size)
        while room > 0 and end > 0:
            taken = self.keep[room, :end]
            back = int(taken[::-1].argmax())
            end -= 1 + back
            if not taken[end]:
                break
            k = self.kind[end]
            out[k] = out.get(k, 0) + self.copies[end]
            room -= self.size[end]
        return out


def solve_program(lengths: np.ndarray, counts: np.ndarray, capacity: int, step: float = STEP, slack: float = SLACK) -> list[tuple[dict[int, int], float]]:
    """Configurations with (fractional) numbers of containers that together cover every length's count.

    A weight per length falls as the length gets covered. One knapsack prices the best configuration and, for
    every length, the best one that holds it; those within ``slack`` of the best, also after what the round has
    taken already, are taken, each as often as covers no length by more than ``step`` of its count. Rounds go on
    until every length is covered; how many that takes depends on the lengths, not on the number of items. What
    is covered more than once is cut back then, configurations of few lengths first, which others make up for.
    """
    covered, price = np.zeros(len(lengths)), lengths / capacity
    taken: dict[tuple, float] = {}
    pricing = Pricing(lengths, counts, capacity)
    while (least := covered.min()) < 1:
        value = np.exp((least - covered) / step * 0.5) * price
        best = pricing.solve(value)
        through = value + best[capacity - lengths]
        enough = (1 - slack) * best[capacity]
        behind = np.argsort(covered, kind="stable")
        for k in [None, *behind[through[behind] >= enough].tolist()]:
            conf = pricing.read(capacity) if k is None else pricing.read(capacity - int(lengths[k]), k)
            ks = np.fromiter(conf, np.int64)
            ns = np.minimum(np.fromiter(conf.values(), float), counts[ks])
            # The first one is the best; after it the weights have changed.
            if k is not None and (np.exp((least - covered[ks]) / step * 0.5) * price[ks]) @ ns < enough:
                continue
            amount = float((step * counts[ks] / ns).min())
            key = tuple(sorted(zip(ks.tolist(), ns.astype(int).tolist())))
            taken[key] = taken.get(key, 0.0) + amount
            covered[ks] += amount * ns / counts[ks]
    out = []
    spare = covered * counts - counts
    for conf, x in sorted(taken.items(), key=lambda p: (len(p[0]), p[0])):
        ks, ns = np.array(conf).T
        cut = min(x, max(0.0, float((spare[ks] / ns).min())))
        spare[ks] -= cut * ns
        if x - cut > 1e-12:
            out.append((dict(conf), x - cut))
    return out


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Longest first into the fullest container that takes it; equal lengths in runs, so that many are no more work."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            fit = min((r for r, group in open_.items() if r >= length and group), default=None)
            if fit is None:
                per = capacity // length
                full, rest = divmod(n, per)
                if full:
                    open_.setdefault(capacity - per * length, []).append(({length: per}, full))
                if rest:
                    open_.setdefault(capacity - rest * length, []).append(({length: rest}, 1))
                break
            conf, many = open_[fit].pop()
            per = min(fit // length, n)
            use = min(many, n // per)
            if many > use:
                open_[fit].append((conf, many - use))
            open_.setdefault(fit - per * length, []).append((conf | {length: conf.get(length, 0) + per}, use))
            n -= use * per
    return [c for group in open_.values() for c in group]


def round_program(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Configurations with whole numbers of containers, and the items that are left.

    The program's solution is rounded up, its largest numbers first, while the items last; what is left gives a
    smaller program, whose rounding accepts more unused room, until less than ``REST`` of the volume is left.
    The work depends on the number of lengths, not of items.
    """
    left, plan, tight = {length: n for length, n in histogram.items() if n > 0}, [], TIGHT
    volume = lambda h: sum(length * n for length, n in h.items())
    rest = REST * volume(left)
    while volume(left) > rest:
        lengths = np.array(sorted(left))
        counts = np.array([left[x] for x in lengths.tolist()], float)
        for conf, x in sorted(solve_program(lengths, counts, capacity), key=lambda p: -p[1]):
            n = min(int(math.ceil(x)), *(left.get(int(lengths[k]), 0) // m for k, m in conf.items()))
            if n > 0 and capacity - sum(int(lengths[k]) * m for k, m in conf.items()) <= tight * capacity:
                plan.append(({int(lengths[k]): m for k, m in conf.items()}, n))
                for k, m in conf.items():
                    left[int(lengths[k])] -= n * m
        left = {length: n for length, n in left.items() if n > 0}
        tight *= 2
    return plan, left


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], list[tuple[dict[int, int], int]]]:
    """(length -> copies, number of containers) of the rounded program, and of its remainder, packed by best fit."""
    plan, left = round_program(histogram, capacity)
    return plan, best_fit(left, capacity)


def count_tokens(docs: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``key, n_tokens`` of every text, whole, in the vocabulary of the tokenizer file.

    The file is read where the driver runs and sent to the executors; a vocabulary has a few MB, whatever the data.
    """
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(vocabulary.value)
        tok.encode_special_tokens = True
        for b in batches:
            texts, n = b.column(1).to_pylist(), []
            for at in range(0, len(texts), 256):
                n += [len(e.ids) for e in tok.encode_batch(texts[at : at + 256], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    kept = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("_text")).where(F.length("_text") > 0)
    return spread(kept).mapInArrow(run, f"`{key}` long, n_tokens long")


def pack(sized: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``key, piece_no, token_from, n_tokens, container_id, by_program`` of every document (``key, n_tokens``).

    Only a document longer than a container is cut, into full containers and a rest. Containers hold at most
    ``capacity`` tokens. Documents without tokens take no room and get no row. The driver sees the histogram of at
    most ``capacity`` lengths and sends back the plan, whose size depends on the lengths only; the k-th item of a
    length finds its container by its rank, which is counted in buckets, so that a length which a third of
    all documents share is spread over many tasks.
    """
    sized = materialise(sized.select(key, "n_tokens"), "sized")  # texts are tokenised once
    n_pieces = F.ceil(F.col("n_tokens") / capacity)
    pieces = sized.where("n_tokens > 0").select(key, "n_tokens", F.explode(F.sequence(F.lit(1), n_pieces.cast("int"))).alias("piece_no"))
    pieces = pieces.select(
        key, "piece_no", ((F.col("piece_no") - 1) * capacity).cast("long").alias("token_from"), F.least(F.lit(capacity), F.col("n_tokens") - (F.col("piece_no") - 1) * capacity).cast("int").alias("length")
    )
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan, rest = plan_containers(histogram, capacity)
    ranges, start, base = [], {}, 0
    for no, (conf, n) in enumerate(plan + rest):
        for length, m in conf.items():
            at = start.get(length, 0)
            ranges.append((length, at, at + n * m, base, m, no < len(plan)))
            start[length] = at + n * m
        base += n
    buckets = int(min(4096, max(16, sum(histogram.values()) // BUCKET_ITEMS)))
    placed = pieces.withColumn("_b", F.pmod(F.xxhash64(key, "piece_no"), F.lit(buckets)))
    counts = placed.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("length", "_b", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    ranked = placed.withColumn("_k", F.row_number().over(Window.partitionBy("length", "_b").orderBy(key, "piece_no")) - 1)
    ranked = ranked.join(before, ["length", "_b"]).withColumn("_k", F.col("_k") + F.col("_o"))
    spark = sized.sparkSession
    # Rows: configurations times the lengths in one; both are bounded by the capacity, not by the data.
    table = spark.createDataFrame(ranges, "length int, _from long, _to long, _base long, _m long, by_program boolean")
    hit = ranked.join(F.broadcast(table), ["length"]).where("_k >= _from and _k < _to")
    return hit.select(key, "piece_no", "token_from", F.col("length").alias("n_tokens"), (F.col("_base") + F.floor((F.col("_k") - F.col("_from")) / F.col("_m"))).cast("long").alias("container_id"), "by_program")
