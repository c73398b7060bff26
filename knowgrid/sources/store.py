"""The index as tables: postings clustered by token, facts, ties, episodes; reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column by which each table's rows lie together, so that a lookup reads few row groups.
CLUSTER = {"posting": "token", "person_topic": "topic", "tie": "a", "episode_posting": "token", "alias": "alias", "episode": "episode"}


def save(tables: dict[str, DataFrame], root: str) -> None:
    """Writes each table sorted within its files by its lookup column; files are ranges of it."""
    for name, df in tables.items():
        by = CLUSTER.get(name)
        out = df.repartitionByRange(by).sortWithinPartitions(by) if by else df
        out.write.mode("overwrite").parquet(f"{root}/{name}")


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def write_report(findings: dict[str, DataFrame], path: str) -> None:
    """All findings as JSON lines, one folder a finding."""
    for name, df in findings.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def redacted_bundle(feedback: DataFrame) -> DataFrame:
    """Votes without what was asked: only how many words a question had."""
    return feedback.select(F.size(F.split(F.trim("query"), r"\s+")).alias("words"), "vote", F.to_date("time").alias("day")).groupBy("words", "vote", "day").agg(F.count(F.lit(1)).alias("n"))
