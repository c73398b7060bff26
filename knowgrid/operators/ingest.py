"""Folding records into people: identity fields, deltas into what is held, ids under their canonical ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowgrid.operators.identity import resolve


def is_placeholder(name: Column) -> Column:
    """A login or a prefixed id in the place of a name."""
    return name.startswith("@") | name.contains(":")


def _last(value: Column, seq: Column, only: Column | None = None) -> Column:
    """The value of the last record (``seq``) that has one; NULL if none has."""
    there = value.isNotNull() & (value != "")
    return F.max(F.when(there if only is None else there & only, F.struct(seq.alias("s"), value.alias("v"))))["v"]


def fold_identities(records: DataFrame, seq: list[str], fields: tuple[str, ...] = ("email", "title", "manager", "team", "org")) -> DataFrame:
    """``id, name, *fields`` of every id: the last value that isn't empty, in the order of ``seq`` (a total order).

    A placeholder never replaces a real name. NULLs in ``seq`` come first; records without an id are left out. One
    aggregation that combines before the shuffle, so an id that a third of all records have costs no more.
    """
    at = F.struct(*seq)
    name = F.coalesce(_last(F.col("name"), at, ~is_placeholder(F.col("name"))), _last(F.col("name"), at))
    return records.where("id is not null").groupBy("id").agg(name.alias("name"), *[_last(F.col(c), at).alias(c) for c in fields])


def fold_records(held: DataFrame, delta: DataFrame, key: str = "id", joined: tuple[str, ...] = (), united: tuple[str, ...] = (), largest: tuple[str, ...] = ()) -> DataFrame:
    """One record for each ``key`` of ``held`` and ``delta``: lists ``joined`` end to end, the held one first, lists
    ``united`` as sorted sets, the ``largest`` of times and weights.

    Folding deltas one after the other gives what folding all of them at once does. NULL lists count as empty.
    """
    both = held.withColumn("_g", F.lit(0)).unionByName(delta.withColumn("_g", F.lit(1))).where(F.col(key).isNotNull())
    empty = F.array()
    ends = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_g", F.coalesce(F.col(c), empty.cast("array<string>")).alias("l")))), lambda x: x["l"])).alias(c) for c in joined]
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.col(c), empty.cast("array<string>")))))).alias(c) for c in united]
    return both.groupBy(key).agg(*ends, *sets, *[F.max(c).alias(c) for c in largest])


def merge_canonical(facts: DataFrame, alias: DataFrame, columns: tuple[str, ...], by: tuple[str, ...], key: str = "person") -> DataFrame:
    """Sums of ``columns`` for each canonical ``key`` and ``by``: ids go through the alias map before anything is summed,
    so that nothing has to be merged afterwards."""
    return resolve(facts, alias, key).groupBy(key, *by).agg(*[F.sum(c).alias(c) for c in columns])
