"""Episodes: sessions by gaps, search over them, recall within a person's own, retention and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int = 1800) -> DataFrame:
    """``events`` with ``session``: a new one begins after more than ``gap_seconds`` without an event of the key."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    prev = F.lag(ts).over(w)
    new = F.when(prev.isNull() | (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(prev.cast("timestamp")) > gap_seconds * 1_000_000), 1).otherwise(0)
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def search(posts: DataFrame, episodes: DataFrame, terms: list[str], as_of: str, k: int = 5, half_life_days: float = 365.0) -> DataFrame:
    """``episode, score, strength`` for terms over ``episode, token, tf`` and ``episode, occurred``.

    Each distinct term gives tf / (tf + 3); the sum is scaled by the share of terms met and by age.
    """
    asked = sorted(set(terms))
    hit = posts.where(F.col("token").isin(*asked)).groupBy("episode").agg(F.sum(F.col("tf") / (F.col("tf") + 3)).alias("s"), F.count_distinct("token").alias("met"))
    age = (F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(F.col("occurred").cast("timestamp"))) / F.lit(86_400_000_000.0)
    fresh = F.when(F.col("occurred").isNull() | (age <= 0), 1.0).otherwise(F.pow(F.lit(0.5), age / half_life_days))
    cov = F.col("met") / len(asked)
    out = hit.join(episodes, ["episode"]).select("episode", F.round(F.col("s") * cov * fresh, 9).alias("score"), F.round(cov, 6).alias("strength"))
    return out.orderBy(F.desc("score"), "episode").limit(k)


def scoped(posts: DataFrame, participants: DataFrame, person: object) -> DataFrame:
    """The postings of episodes that ``person`` took part in."""
    return posts.join(participants.where(F.col("person") == person).select("episode").distinct(), ["episode"], "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str, keep_if_missing: tuple[str, ...]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` by key; the columns named keep their old value where the new one is NULL."""
    fresh = F.col("_in_new").isNotNull()
    j = old.alias("o").join(new.withColumn("_in_new", F.lit(1)).alias("n"), [key], "full")
    cols = [F.when(fresh, F.coalesce(f"n.{c}", f"o.{c}") if c in keep_if_missing else F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns if c != key]
    return j.select(key, *cols)


def watermarks(runs: DataFrame) -> DataFrame:
    """``source, scope, cursor``: the furthest complete run; a cursor never moves back."""
    return runs.where("complete").groupBy("source", "scope").agg(F.max("cursor").alias("cursor"))


def shrink_guard(before: DataFrame, after: DataFrame, share: float = 0.5) -> DataFrame:
    """Sources (``source, n``) that returned less than ``share`` of last time: they must not replace it."""
    return before.withColumnRenamed("n", "old").join(after.withColumnRenamed("n", "new"), ["source"], "left").where(F.coalesce("new", F.lit(0)) < F.col("old") * share).select("source", "old", F.coalesce("new", F.lit(0)).alias("new"))
