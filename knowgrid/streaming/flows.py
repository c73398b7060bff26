"""Streams: sessions with a watermark, duplicates dropped, idempotent folds per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from knowgrid.session import materialise


def event_stream(spark: SparkSession, folder: str, schema: str, max_files: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def session_counts(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``key, first_ts, last_ts, n`` of sessions closed by ``gap``; later events than the watermark are dropped."""
    e = events.withWatermark(ts, late)
    w = F.session_window(ts, gap)
    return e.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).select(key, "first_ts", "last_ts", "n")


def once(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each id once within the watermark: edits delivered twice don't count twice."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Works off what has arrived and stops; offsets are kept in ``checkpoint`` (a shared folder)."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()
    return q


def fold_batch(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that keeps the latest row of each key in a table of buckets; redoing a batch changes nothing.

    Only the buckets that the batch touches are read and rewritten.
    """

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(64)).cast("int"))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most 64
        try:
            old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
            both = old.unionByName(new, allowMissingColumns=True)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            both = new
        cols = [c for c in both.columns if c not in (key, "bucket")]
        last = both.groupBy(key, "bucket").agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "bucket", "r.*")
        last = materialise(last, "fold")  # the buckets are read before they are replaced
        last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return each
