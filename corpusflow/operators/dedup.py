"""Keep-first deduplication and containment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order; the same one however rows are partitioned."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def jobs(rows: DataFrame) -> DataFrame:
    """(url, pos, …): one row per address; rows without an address all stay."""
    blank = F.coalesce(F.col("url"), F.lit("")) == ""
    return rows.where(blank).unionByName(keep_first(rows.where(~blank), ["url"], ["pos"]))


def consecutive(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value isn't the previous one's."""
    return rows.withColumn("_b", F.lag(value).over(Window.partitionBy(key).orderBy(order))).where(F.col("_b").isNull() | (F.col("_b") != F.col(value))).drop("_b")


def drawn_texts(rows: DataFrame, key: str, order: str, value: str, least: int = 3, total: int = 100) -> DataFrame:
    """(key, text): distinct texts of over `least` characters in order of first sight, joined by line ends, if the
    result has over `total` characters."""
    first = rows.where(F.length(value) > least).groupBy(key, value).agg(F.min(order).alias("at"))
    joined = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("v")))).alias("t"))
    return joined.select(key, F.array_join(F.col("t.v"), "\n").alias("text")).where(F.length("text") > total)


def drop_contained(rows: DataFrame, key: str, value: str, size: int = 8, most_work: int = 1 << 28, most_chars: int = 1 << 24) -> DataFrame:
    """Rows whose value isn't strictly inside a longer value of the same key; null values and null keys stay.

    A key's rows move once and are compared with each other where they are. Only keys of over most_chars characters, or
    for which characters times rows is over most_work, go by stretches instead, as _contained_by_stretches() says."""
    text, whole = F.col(value), Window.partitionBy(key)
    # a null key equals none: as one group its rows would only be large
    chars = F.sum(F.length(text)).over(whole)
    sized = rows.withColumn("_large", F.col(key).isNotNull() & ((chars > most_chars) | (chars * F.count(text).over(whole) > most_work)))
    fits = F.col(key).isNotNull() & ~F.coalesce("_large", F.lit(False))
    own = F.struct(F.length(text).alias("n"), text.alias("v"))
    rest = sized.withColumn("_all", F.collect_list(F.when(fits & text.isNotNull(), own)).over(whole))
    inside = F.exists("_all", lambda x: (x["n"] > F.length(text)) & x["v"].contains(text))
    near = rest.where(~F.coalesce("_large", F.lit(False)) & ~F.coalesce(inside, F.lit(False))).select(*rows.columns)
    large = sized.where("_large").select(*rows.columns)
    gone = _contained_by_stretches(large, key, value, size)
    return near.unionByName(large.join(gone.hint("merge"), (F.col(key) == F.col("_k")) & (text == F.col("_v")), "left_anti"))


def _contained_by_stretches(rows: DataFrame, key: str, value: str, size: int, piece: int = 1 << 16) -> DataFrame:
    """(_k, _v): the values strictly inside a longer one of the same key.

    A value can only be inside another that has its first `size` characters (all of a shorter one). Values stay where
    they are and only hashes of these and of the values' stretches meet; the pairs that do are compared as texts."""
    texts = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v")).distinct()
    texts = texts.withColumn("_id", F.xxhash64("_v"))
    head = F.substring("_v", 1, size)
    heads = texts.select("_k", F.length(head).alias("_n"), F.xxhash64(head).alias("_g"), F.col("_id").alias("_short")).distinct()
    sizes = F.collect_set(F.least(F.length("_v"), F.lit(size))).over(Window.partitionBy("_k"))
    pieces = texts.withColumn("_sizes", sizes).withColumn("_at", F.explode(F.sequence(F.lit(0), F.floor(F.length("_v") / piece).cast("int"))))
    pieces = pieces.select("_k", "_id", F.explode("_sizes").alias("_n"), F.substr("_v", F.col("_at") * piece + 1, F.lit(piece + size - 1)).alias("_p"))
    found = F.regexp_extract_all("_p", F.concat(F.lit("(?s)(?=(.{"), F.col("_n").cast("string"), F.lit("}))")), F.lit(1))
    stretches = F.array_distinct(F.transform(F.when(F.col("_n") > 0, found).otherwise(F.array(F.lit(""))), lambda x: F.xxhash64(x)))
    held = pieces.select("_k", "_n", F.col("_id").alias("_long"), F.explode(stretches).alias("_g"))
    # merges, since stretches are many times what their source's size lets Spark expect, too much to broadcast
    pairs = held.hint("merge").join(heads, ["_k", "_n", "_g"]).select("_k", "_short", "_long").distinct()
    long = texts.select("_k", F.col("_id").alias("_long"), F.col("_v").alias("_w"))
    met = pairs.hint("merge").join(texts.withColumnRenamed("_id", "_short"), ["_k", "_short"]).join(long.hint("merge"), ["_k", "_long"])
    return met.where((F.length("_w") > F.length("_v")) & F.col("_w").contains(F.col("_v"))).select("_k", "_v").distinct()


def best_of_many(results: DataFrame, most: int = 3, least: float = 0.5) -> DataFrame:
    """(query_id, round, url, text, score) → the results of a query's first `most` rounds up to and with the first whose
    score is under `least`; those without text go, and of one address the first stays."""
    weak = (F.coalesce("score", F.lit(0.0)) < least).cast("int")
    before = Window.partitionBy("query_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    rows = results.where(F.col("round") < most).withColumn("_ended", F.coalesce(F.max(weak).over(before), F.lit(0))).where("_ended = 0").drop("_ended")
    return keep_first(rows.where(F.length("text") > 0), ["query_id", "url"], ["round"])


def across_platforms(listings: list[DataFrame]) -> DataFrame:
    """Postings of several platforms as one table, each address once, in the order given; (url, pos, ...) each."""
    rows = [d.withColumn("pos", F.struct(F.lit(k).alias("platform_pos"), F.col("pos").alias("at"))) for k, d in enumerate(listings)]
    return jobs(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows))
