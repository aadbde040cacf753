"""The whole loop over many queries at once: search, verify, extract, validate, choose."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators import align, select, serp


@dataclass(frozen=True)
class Config:
    max_results: int = 20
    max_candidates: int = 10
    min_preview: int = 50
    min_completeness: float = 0.5
    max_urls: int = 3
    keyword: str | None = None
    early_stop: bool = True


def run(results: DataFrame, previews: DataFrame, outputs: DataFrame, config: Config = Config(), keywords: DataFrame | None = None) -> DataFrame:
    """One row per query that has a candidate.

    results: (query_id, backend, backend_pos, rank, url); previews: (url, preview); outputs: (url, stage_index,
    stage_name, text); keywords: (query_id, keyword) of queries that have one of their own, else config.keyword is
    everyone's. Addresses are merged, ranked and filtered before any text is read; what remains of a query meets its
    texts by address and then stays with the query. A text must agree with the first 2,000 characters of its preview.
    """
    ranked = serp.worth_reading(serp.top(serp.merge(results), config.max_results)).select("query_id", F.col("rank").alias("pos"), "url")
    candidates = ranked.join(previews, "url").select("query_id", "pos", "url", "preview")
    own = keywords is not None
    if own:
        candidates = candidates.join(keywords.select("query_id", "keyword"), "query_id", "left")
    verified = select.verify(candidates, config.keyword, config.max_candidates, config.min_preview, config.early_stop)
    tried = verified.where(F.col("rank") <= config.max_urls).select("query_id", F.col("rank").alias("url_rank"), "url")
    seen = candidates.select("query_id", "url", F.substring("preview", 1, 2000).alias("preview"), *(["keyword"] if own else []))
    stages = tried.join(outputs, "url").join(seen, ["query_id", "url"]).select("query_id", "url_rank", "url", "stage_index", "stage_name", "text", "preview", *(["keyword"] if own else []))
    return select.chain(stages, config.keyword, config.min_completeness, config.max_urls)


def cross_validated(found: DataFrame, chapters: DataFrame, strategy: str = "longest") -> DataFrame:
    """found with cross_validated and cross_text: for queries that succeeded and have chapters of several sources
    (query_id, source_idx, source_name, ordinal, title, text), these aligned, merged and cleaned to one text."""
    own = chapters.join(found.where("success").select("query_id"), "query_id", "left_semi").withColumnRenamed("query_id", "work_id")
    placed = align.align(own).join(own, ["work_id", "source_idx", "ordinal"])
    merged = align.merge(placed, strategy)
    books = merged.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("num", "title", "text"))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.concat(x["title"], F.lit("\n\n"), x["text"])), "\n\n")
    whole = align.auto_clean(books.select(F.col("work_id").alias("key"), text.alias("text")))
    joined = found.join(whole.select(F.col("key").alias("query_id"), F.col("text").alias("cross_text")), "query_id", "left")
    return joined.withColumn("cross_validated", F.col("cross_text").isNotNull())
