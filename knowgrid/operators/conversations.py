"""Conversations: threads put together, replies folded in, budgets, both ends kept, episodes of all kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repair_threads(messages: DataFrame) -> DataFrame:
    """Parents (``channel, ts, thread_ts, user, text``) with ``replies, repliers, last_reply`` rebuilt from the replies."""
    r = _replies(messages)
    parents = messages.where("thread_ts is null or thread_ts = ts")
    return parents.join(r, ["channel", "ts"], "left").withColumn("replies", F.coalesce("replies", F.lit(0)))


def _replies(messages: DataFrame) -> DataFrame:
    own = messages.where("thread_ts is not null and thread_ts <> ts").select("channel", F.col("thread_ts").alias("parent"), "user", F.col("ts").alias("at"))
    g = own.groupBy("channel", "parent").agg(F.count(F.lit(1)).alias("replies"), F.array_sort(F.collect_set("user")).alias("repliers"), F.max("at").alias("last_reply"))
    return g.withColumnRenamed("parent", "ts")


def enrich_threads(parents: DataFrame, messages: DataFrame, keep: int = 20) -> DataFrame:
    """``channel, ts, participants, body``: a parent's text with its first ``keep`` replies, and who spoke, in order.

    Replies beyond ``keep`` are cut by rank before they are collected, so no list outgrows it.
    """
    w = Window.partitionBy("channel", "thread_ts").orderBy("ts", "user")
    r = messages.where("thread_ts is not null and thread_ts <> ts").withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)
    said = r.groupBy("channel", "thread_ts").agg(F.array_sort(F.collect_list(F.struct("r", "user", "text"))).alias("l"))
    j = parents.join(said.withColumnRenamed("thread_ts", "ts"), ["channel", "ts"], "left")
    who = F.array_distinct(F.concat(F.array("user"), F.coalesce(F.transform("l", lambda x: x["user"]), F.array().cast("array<string>"))))
    body = F.concat_ws("\n", F.array("text"), F.transform("l", lambda x: x["text"]))
    return j.select("channel", "ts", who.alias("participants"), body.alias("body"))


def within_budget(rows: DataFrame, key: str, order: str | Column, text: str, limit: int) -> DataFrame:
    """Rows of each key, in order, while the bytes of those before are under ``limit``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_b", F.coalesce(F.sum(F.octet_length(text)).over(w), F.lit(0))).where(F.col("_b") < limit).drop("_b")


def both_ends(rows: DataFrame, key: str, order: str, first: int = 4, last: int = 8) -> DataFrame:
    """The first and the last rows of each key; all, if there are no more than both."""
    up = F.row_number().over(Window.partitionBy(key).orderBy(F.asc(order)))
    down = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_u", up).withColumn("_d", down).where((F.col("_u") <= first) | (F.col("_d") <= last)).drop("_u", "_d")


def newest(rows: DataFrame, key: str, order: str, id_: str, keep: int = 200) -> DataFrame:
    """The newest ``keep`` rows of each key."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), id_))
    return rows.withColumn("_r", r).where(F.col("_r") <= keep).drop("_r")


def incident_episodes(incidents: DataFrame, notes: DataFrame) -> DataFrame:
    """``episode, kind, title, body, participants, messages`` of incidents: latest delivery of each, its notes in order."""
    last = incidents.groupBy("incident_id").agg(F.max(F.struct("ingested_at", "row_id", "title", "description", "assignee_email")).alias("i"))
    n = notes.select("incident_id", "author_email", "noted_at", "content").distinct().groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("noted_at", "author_email", "content"))).alias("l"))
    j = last.join(n, ["incident_id"], "left")
    who = F.array_distinct(F.array_compact(F.concat(F.array("i.assignee_email"), F.coalesce(F.transform("l", lambda x: x["author_email"]), F.array().cast("array<string>")))))
    body = F.concat_ws("\n", F.col("i.description"), F.transform("l", lambda x: x["content"]))
    return j.select(F.col("incident_id").alias("episode"), F.lit("incident").alias("kind"), F.col("i.title").alias("title"), body.alias("body"), who.alias("participants"), F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("messages"))


def purge(rows: DataFrame, ts: str, cutoff: str) -> DataFrame:
    """Without rows older than ``cutoff``; undated ones stay."""
    return rows.where(F.col(ts).isNull() | (F.col(ts) >= F.to_timestamp(F.lit(cutoff)).cast("timestamp_ntz")))
