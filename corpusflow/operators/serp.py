"""Search results of several backends: parsing, merging, ranking and filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions import classify as C
from corpusflow.functions.text import col


def distinct_in_order(urls: Column, most: int) -> Column:
    """The non-empty addresses, each once and where it came first, at most `most`; none for null."""
    return F.slice(F.array_distinct(F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: u.isNotNull() & (u != ""))), 1, most)


def brave_urls(body: Column | str, most: int = 20) -> Column:
    parsed = F.from_json(body, "web struct<results: array<struct<url: string>>>")
    return distinct_in_order(parsed["web"]["results"]["url"], min(most, 20))


def exa_urls(body: Column | str, most: int = 10) -> Column:
    return distinct_in_order(F.from_json(body, "results array<struct<url: string>>")["results"]["url"], min(most, 10))


def searxng_urls(body: Column | str, most: int = 20) -> Column:
    return distinct_in_order(F.from_json(body, "results array<struct<url: string>>")["results"]["url"], most)


def duckduckgo_instant_urls(body: Column | str, most: int = 20) -> Column:
    parsed = F.from_json(body, "RelatedTopics array<struct<FirstURL: string>>, Results array<struct<FirstURL: string>>")
    none = F.array().cast("array<string>")
    return distinct_in_order(F.concat(F.coalesce(parsed["RelatedTopics"]["FirstURL"], none), F.coalesce(parsed["Results"]["FirstURL"], none)), most)


def duckduckgo_lite_urls(html: Column | str, most: int = 20) -> Column:
    """Links of class result-link (class before href), else redirect parameters; nothing from a page that asks for a
    human."""
    links = F.regexp_extract_all(html, F.lit("""class=["']result-link["'][^>]*href=["']([^"']+)["']"""), 1)
    links = F.filter(links, lambda u: ~u.startswith("//"))
    decoded = F.transform(F.regexp_extract_all(html, F.lit("uddg=([^&\"']+)"), 1), lambda u: F.try_url_decode(u))
    blocked = F.rlike(html, F.lit("(?i)anomaly-modal|complete the following challenge"))
    return F.when(blocked, F.array().cast("array<string>")).otherwise(distinct_in_order(F.when(F.size(links) > 0, links).otherwise(decoded), most))


def first_backend(*urls: Column) -> Column:
    """The first backend's addresses that aren't empty."""
    return F.coalesce(*[F.when(F.size(u) > 0, u) for u in urls], F.array().cast("array<string>"))


def merge(serp: DataFrame) -> DataFrame:
    """(query_id, url, cross_hits, avg_rank, backends) from (query_id, backend, backend_pos, rank, url).

    cross_hits counts rows, so a backend that lists an address twice counts twice; avg_rank is the mean of each
    backend's last rank; backends are in backend order with repetitions. Null addresses are left out.
    """
    per = serp.where("url is not null").groupBy("query_id", "url", "backend_pos", "backend").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank"))
    rows = per.groupBy("query_id", "url").agg(F.sum("n").alias("cross_hits"), F.sum("rank").alias("total"), F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_list(F.struct("backend_pos", "backend", "n"))).alias("b"))
    spelled = F.flatten(F.transform("b", lambda x: F.array_repeat(x["backend"], x["n"].cast("int"))))
    return rows.select("query_id", "url", "cross_hits", (F.col("total") / F.col("k")).alias("avg_rank"), spelled.alias("backends"))


def top(merged: DataFrame, most: int = 20) -> DataFrame:
    """merged with rank from 1, the first `most` per query by hits, then mean rank, then address downwards."""
    order = Window.partitionBy("query_id").orderBy(F.desc("cross_hits"), F.asc("avg_rank"), F.desc("url"))
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def stats(serp: DataFrame) -> DataFrame:
    """(query_id, backend, hits, total_raw, total_unique): a row for each backend that gave something."""
    rows = serp.where("url is not null")
    totals = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_raw"), F.count_distinct("url").alias("total_unique"))
    return rows.groupBy("query_id", "backend").agg(F.count(F.lit(1)).alias("hits")).join(totals, "query_id")


def worth_reading(results: DataFrame, url: str = "url") -> DataFrame:
    """Results whose address is content or a table of contents, with the verdict; decided before anything is fetched."""
    verdict = C.classify_url(col(url))
    return results.withColumn("verdict", verdict).where(F.col("verdict.is_content") | (F.col("verdict.type") == "novel_index"))
