"""Code changes, pages, directories and on-call rotas landed as JSON, as evidence of who works on what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowgrid.functions import text as T
from knowgrid.functions.identity import normalize_email
from knowgrid.sources.records import as_records


def change_topics(changes: DataFrame) -> DataFrame:
    """``person, topic, stated, n`` of merged changes and issues: author, reviewers, assignees and helpers on labels (stated)
    and phrases of the title.

    ``changes`` is ``id, author, reviewers, assignees, helpers, labels, title``; a person counts once a change, machines
    don't count.
    """
    none = F.array().cast("array<string>")
    everybody = F.concat(F.array("author"), *[F.coalesce(c, none) for c in ("reviewers", "assignees", "helpers")])
    c = changes.select("id", F.explode(F.array_distinct(F.array_compact(everybody))).alias("person"), F.transform(F.coalesce("labels", none), lambda t: T.topic_id(t)).alias("l"), T.phrase_tokens(F.col("title")).alias("t"))
    c = c.where(~T.is_automation(F.col("person"), F.lit("")))
    both = c.select("person", F.explode("l").alias("topic"), F.lit(True).alias("stated")).unionByName(c.select("person", F.explode("t").alias("topic"), F.lit(False).alias("stated")))
    return both.where("topic <> ''").groupBy("person", "topic", "stated").agg(F.count(F.lit(1)).alias("n"))


def helpers(changes: DataFrame, comments: DataFrame) -> DataFrame:
    """``id, person``: who reviewed or commented on a merged change beyond its author and those asked."""
    none = F.array().cast("array<string>")
    asked = F.concat(F.array("author"), F.coalesce("requested", none), F.coalesce("assignees", none))
    j = comments.join(changes.where("merged").select("id", asked.alias("asked")), ["id"])
    return j.where(~F.array_contains("asked", F.col("person"))).select("id", "person").distinct()


def process_free(ties: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Ties without labels of the process at either end."""
    return ties.where(~F.lower("a").isin(*labels) & ~F.lower("b").isin(*labels))


def page_topics(pages: DataFrame, body_bytes: int = 8000) -> DataFrame:
    """``person, topic, stated, n`` of pages: creator and last editor, once if they are the same, on labels, title, space, body."""
    none = F.array().cast("array<string>")
    who = F.array_distinct(F.array_compact(F.array("created_by", "edited_by")))
    words = F.concat(T.phrase_tokens(F.col("title")), F.array_compact(F.array(F.lower("space"))), T.title_tokens(T.truncate_bytes(F.col("body"), body_bytes)))
    p = pages.select(F.explode(who).alias("person"), F.transform(F.coalesce("labels", none), lambda t: T.topic_id(t)).alias("l"), words.alias("t"))
    both = p.select("person", F.explode("l").alias("topic"), F.lit(True).alias("stated")).unionByName(p.select("person", F.explode("t").alias("topic"), F.lit(False).alias("stated")))
    return both.where("topic <> ''").groupBy("person", "topic", "stated").agg(F.count(F.lit(1)).alias("n"))


def directory_users(spark: SparkSession, path: str) -> DataFrame:
    """Person records of a user directory (JSON lines ``mail, userPrincipalName, displayName, jobTitle, department, manager``)."""
    u = spark.read.schema("mail string, userPrincipalName string, displayName string, jobTitle string, department string, manager string").json(path)
    mail = normalize_email(F.coalesce("mail", "userPrincipalName"))
    alt = F.array_compact(F.array(F.when(normalize_email(F.col("userPrincipalName")) != mail, normalize_email(F.col("userPrincipalName")))))
    return as_records(u, "person", "graph", person_id=mail, name=F.col("displayName"), email=mail, alt_ids=alt, title=F.col("jobTitle"), team=F.col("department"), manager=normalize_email(F.col("manager")))
