"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import fresh, ranked, table, unit


def _merged(sources: list[tuple[str | None, int]], source: Column, rank: Column, size: Column) -> Column:
    """How many rows come up to a row in the order by (fractional rank, source, rank): of each source those whose
    (2 r - 1) / (2 n) is less than the row's, or equal if the source isn't behind the row's. Exact in integers."""
    wide = "decimal(38,0)" if sum(n for _, n in sources) > 1_000_000_000 else "bigint"
    odd, size = (2 * rank - 1).cast(wide), size.cast(wide)
    upto = F.lit(0).cast("bigint")
    for name, n in sources:
        behind = F.lit(0) if name is None else F.when(source >= F.lit(name), 0).otherwise(1)
        upto = upto + F.least(F.lit(n).cast("bigint"), F.call_function("div", odd * F.lit(n).cast(wide) - behind + size, 2 * size))
    return upto


def shard(documents: DataFrame, shards: int = 64, seed: int = 17, counted: int = 64) -> DataFrame:
    """documents with source_rank, position and shard (names get underscores where taken).

    Within each source rows are shuffled by md5(seed:doc_id) and ranked; a row's fractional rank is
    (source_rank - 1/2) / rows of the source. position, from 1, is the order by fractional rank, then source, then
    source_rank; shard is floor((position - 1) * shards / rows), so sizes differ by one at most and each source's
    share of a shard differs from its share of the table by less than one row per source and shard boundary.

    A null source is a source of its own, before the others at ties. Null doc_ids shuffle as the empty string. Rows
    of one doc_id are ordered by their hash over all columns; equal rows are interchangeable. Texts don't matter: null,
    empty and long ones are kept as they are. An empty table gives no rows.

    A hot source doesn't end up in one task: ranks are counted in buckets of about 4,000 rows and only counts are
    summed over all. Of at most `counted` sources the place of a rank in the merged order follows from the sources'
    sizes, so whole rows move once; with more, the fractional ranks are ranked as well and rows move twice.
    """
    names = documents.columns
    key, at, size, fraction, rank, position, out = (fresh(names, c) for c in ("_key", "_at", "_size", "_fraction", "source_rank", "position", "shard"))
    total = documents.count()
    sources = [(r[0], r[1]) for r in documents.groupBy("source").count().limit(counted + 1).collect()]
    plain = [F.col(c).cast("string") if t == "void" or t.startswith("map") else F.col(c) for c, t in documents.dtypes]
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = documents.withColumn(key, hashed).withColumn(at, unit(F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")))
    placed = ranked(keyed, ["source"], at, [F.col(key), F.col("doc_id").asc_nulls_first(), F.xxhash64(*plain)], rank, total, size)
    if len(sources) <= counted:
        placed = placed.withColumn(position, _merged(sources, F.col("source"), F.col(rank), F.col(size)))
    else:
        placed = placed.withColumn(fraction, (2 * F.col(rank) - 1).cast("double") / (2 * F.col(size)).cast("double"))
        placed = ranked(placed, [], fraction, [F.col("source").asc_nulls_first(), F.col(rank)], position, total)
    return placed.select(*names, rank, position, F.expr(f"int(((`{position}` - 1) * {shards}) div {max(1, total)})").alias(out))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op5_sharding": op5_sharding}
SQL = {
    "op5_sharding": """
        WITH r AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('17:' || doc_id), doc_id) AS source_rank,
                   count(*) OVER (PARTITION BY source) AS size
            FROM documents
        ), p AS (
            SELECT *, row_number() OVER (ORDER BY CAST(2 * source_rank - 1 AS DOUBLE) / CAST(2 * size AS DOUBLE), source, source_rank) AS position,
                   count(*) OVER () AS total
            FROM r
        )
        SELECT doc_id, text, lang, source, n_chars, source_rank, position, CAST(((position - 1) * 64) // total AS INTEGER) AS shard
        FROM p
    """
}
