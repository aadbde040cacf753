"""Batch files of work and rendered results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import rx
from corpusflow.functions.text import col, domain, source_name


def items(lines: DataFrame) -> DataFrame:
    """(value, …) → (item, is_url, …): lines that aren't blank or comments."""
    rows = lines.withColumn("item", rx.strip(F.col("value"))).drop("value").where((F.col("item") != "") & ~F.col("item").startswith("#"))
    return rows.withColumn("is_url", F.rlike("item", F.lit("^https?://")))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return items(spark.read.text(path))


def with_domain(rows: DataFrame, url: str = "url") -> DataFrame:
    return rows.withColumn("domain", domain(url)).withColumn("source_name", source_name(url))


#: The fields of a result and their types, as results are written; missing ones are null.
RESULT = {
    "success": "boolean", "score": "double", "url": "string", "text": "string", "winning_stage": "string", "stages_attempted": "bigint", "stages_succeeded": "bigint", "total_time_ms": "bigint",
    "search_candidates_total": "bigint", "search_candidates_scanned": "bigint", "validation": "struct<checks: array<string>, passed: int, failed: int, result: string>",
    "extraction_chain": "array<struct<stage: string, success: boolean, completeness: double, error: string, timing_ms: bigint>>",
}


def results(rows: DataFrame) -> DataFrame:
    """rows with every field of RESULT."""
    return rows.withColumns({name: F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind) for name, kind in RESULT.items()})


def result_json(first: list[str] | None = None) -> Column:
    """A result of results() as a JSON object, behind the named columns."""
    return F.to_json(F.struct(*(first or []), *RESULT), {"ignoreNullFields": "false"})


def result_markdown() -> Column:
    """One result as a document."""
    text = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    lines = [("Status", F.when(F.col("success"), "success").otherwise("best-effort")), ("Score", F.format_string("%.3f", F.bround(F.coalesce("score", F.lit(0.0)), 3))), ("URL", text("url", "")), ("Stage", text("winning_stage", "none")), ("Time", F.concat(text("total_time_ms", "0"), F.lit(" ms")))]
    return F.concat(F.lit("# Extraction result\n\n"), *[x for name, value in lines for x in (F.lit(f"- {name}: "), value, F.lit("\n"))], F.lit("\n## Content\n\n"), text("text", ""), F.lit("\n"))


def document(rows: DataFrame, form: str = "text") -> DataFrame:
    """(key, pos, input and what RESULT has) → (key, document): a key's results as one text, as Markdown under one
    heading with score and address of each, or as a JSON array of whole results."""
    rows = results(rows)
    text = F.coalesce("text", F.lit(""))
    section = F.concat(F.lit("## "), "input", F.lit("\n\n- Score: "), F.format_string("%.3f", F.bround(F.coalesce("score", F.lit(0.0)), 3)), F.lit("\n- URL: "), F.coalesce("url", F.lit("")), F.lit("\n\n"), text)
    shown, before, between, after = {"text": (text, "", "\n\n=====\n\n", ""), "md": (section, "# Batch results\n\n", "\n\n", ""), "json": (result_json(["input"]), "[", ",", "]")}[form]
    joined = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("s")))).alias("a"))
    return joined.select("key", F.concat(F.lit(before), F.array_join(F.col("a.s"), between), F.lit(after)).alias("document"))


def truncated(text: Column | str, most: int = 5000) -> Column:
    """struct(text, truncated, original_length) as a tool's answer has it."""
    return F.struct(F.substring(text, 1, most).alias("text"), (F.length(text) > most).alias("truncated"), F.length(text).alias("original_length"))


def search_report(results: DataFrame, form: str = "md") -> DataFrame:
    """(query_id, rank, url, cross_hits, backends) → (query_id, report): the addresses line by line, a numbered list of
    links with their backends under a heading, or a JSON array."""
    line = {
        "text": F.col("url"),
        "md": F.concat(F.col("rank").cast("string"), F.lit(". ["), "url", F.lit("]("), "url", F.lit(") — "), F.array_join("backends", ", ")),
        "json": F.to_json(F.struct("rank", "url", "cross_hits", "backends")),
    }[form]
    before, between, after = {"text": ("", "\n", ""), "md": ("# Search results\n\n", "\n", ""), "json": ("[", ",", "]")}[form]
    rows = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("a"))
    return rows.select("query_id", F.concat(F.lit(before), F.array_join(F.col("a.l"), between), F.lit(after)).alias("report"))


def all_succeeded(results: DataFrame) -> DataFrame:
    """(status): 0 if there is a result and every one has text, else 2."""
    good = F.coalesce(F.bool_and(F.length(F.coalesce("text", F.lit(""))) > 0), F.lit(False))
    return results.agg(F.when(good, 0).otherwise(2).alias("status"))
