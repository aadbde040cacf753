"""Helpers the operators share: reading, cutting lineage, bounded model shipping and ranks without hot partitions."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a temporary folder serves a local master (tests);
    on a cluster, whose machines don't share one, that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusflow-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table, in whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder. Spark removes it when nothing refers to it if
    spark.cleaner.referenceTracking.cleanCheckpoints is true; else it stays until the folder is emptied."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """Broadcast hint only while rows * row_bytes stays under limit; beyond it the join shuffles both sides."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def unit(hash60: Column) -> Column:
    """A hash in [0, 2^60) as a double in [0, 1], never decreasing in the hash."""
    return hash60.cast("double") / F.lit(float(1 << 60))


def hash60(*columns: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 4)


def fresh(names: Sequence[str], wanted: str) -> str:
    """wanted, or wanted with underscores until no column of that name exists."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def ranked(df: DataFrame, keys: list[str], where: str, order: list[Column], rank: str, total: int, size: str | None = None, bucket_rows: int = 4000, narrow: DataFrame | None = None) -> DataFrame:
    """Adds rank, 1.. within keys by (where, order), and size, the rows of the keys; where has doubles in [0, 1].

    A window over keys alone would sort a hot key in one task. Here keys and an order-preserving bucket of
    `where` make the window's partitions, of about bucket_rows rows each, and the buckets' counts, summed over
    the lower buckets, give what to add. Keys are compared as strings that are never null, so the counts join on the
    window's own partitioning: rows move once, whether or not the counts can be broadcast. narrow has the keys and
    `where` of all rows, if they can be had for less than df's.
    """
    n = max(1, -(-total // bucket_rows))
    bucket, below, count, whole = (fresh(df.columns, c) for c in ("_bucket", "_below", "_count", "_whole"))
    alias = [fresh(df.columns, f"_k{i}") for i in range(len(keys))]
    extra = {a: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k, a in zip(keys, alias)}
    extra[bucket] = F.least(F.floor(F.col(where) * n), F.lit(n - 1)).cast("int")
    spread = df.withColumns(extra)
    counts = (df if narrow is None else narrow).withColumns(extra).groupBy(*alias, bucket).agg(F.count(F.lit(1)).alias(count))
    one = [F.col(a) for a in alias] or [F.lit(0)]
    before = Window.partitionBy(*one).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*alias, bucket, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(below), F.sum(count).over(Window.partitionBy(*one)).alias(whole))
    inside = Window.partitionBy(*alias, bucket).orderBy(F.col(where), *order)
    joined = spread.withColumn(rank, F.row_number().over(inside)).join(offsets, [*alias, bucket])
    added = [(F.col(rank) + F.col(below)).cast("bigint").alias(rank), *([F.col(whole).alias(size)] if size else [])]
    return joined.select(*df.columns, *added)
