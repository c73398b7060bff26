"""Session helpers: table loading and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, or one of our own where none is set (tests, a laptop)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    sc = spark.sparkContext
    own = sc.getCheckpointDir()
    if own:
        return own
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="knowgrid-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame, label: str = "step", partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage; the copy is compressed and column-pruned, its size is known to the planner, and it
    outlives any executor. ``partitions`` coalesces the output files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/knowgrid-{label}-{uuid.uuid4().hex}"
    if partitions:
        df = df.coalesce(partitions)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._knowgrid_path = path  # type: ignore[attr-defined]
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it lies in fewer pieces than there are cores, as a small file does; else as it is.

    For operators that spend far more time on a row than moving it takes. Large inputs are never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows of ``df`` (all, if there are fewer), the same on every run: those of the smallest hash of ``key``.

    Rows beyond about 2n are dropped where they are read, so what reaches one task or the driver doesn't grow with
    the table.
    """
    total, h = df.count(), F.xxhash64(F.col(key), F.lit(17))
    if total > 4 * n:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * 2 * n / total))
    return df.orderBy(h, key).limit(n)


def hot_keys(rows: DataFrame, key: str, total: int, most: int, share: int = 1_000) -> DataFrame | None:
    """``_at, _parts``: keys that more than ``most`` rows, and more than one in ``share`` of the ``total``, have, with the
    number of tasks that each is worth. No more than ``share`` keys can be hot. None if there are none."""
    limit = max(most, total // share)
    if total <= limit:
        return None
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_at")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    found = counts.select("_at", F.ceil(F.col("_n") / limit).cast("int").alias("_parts")).collect()
    return rows.sparkSession.createDataFrame(found, T.StructType([T.StructField("_at", rows.schema[key].dataType), T.StructField("_parts", T.IntegerType())])) if found else None


def look_up(rows: DataFrame, key: str, by: str, table: DataFrame, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` with what ``table`` (one row for each ``_at``) says of their ``key``.

    The rows of a hot key, told apart by ``by``, meet as many copies of its row as it is worth tasks.
    """
    if hot is None:
        return rows.join(table, F.col(key) == F.col("_at"), how).drop("_at")
    parts = F.broadcast(hot)
    salt = F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0)).cast("int")
    salted = rows.join(parts.withColumnRenamed("_at", key), [key], "left").withColumn("_salt", salt).drop("_parts")
    copies = table.join(parts, ["_at"], "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    return salted.join(copies, (F.col(key) == F.col("_at")) & (F.col("_salt") == F.col("_s")), how).drop("_at", "_salt", "_s")


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing lazy refers to it."""
    path = getattr(df, "_knowgrid_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
