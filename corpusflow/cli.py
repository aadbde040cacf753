"""search, run, extract, batch and crawl over tables of what has been fetched."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import links, select, serp
from corpusflow.plans import pipeline
from corpusflow.plans.stages import Registry, fetches
from corpusflow.sources import batch


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="corpusflow", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name, inputs in (("search", ["serp"]), ("run", ["serp", "fetches"]), ("extract", ["fetches"]), ("batch", ["items", "fetches"]), ("crawl", ["pages"])):
        verb = verbs.add_parser(name)
        for table in inputs:
            verb.add_argument(f"--{table}", required=True, help=f"{'text file' if table == 'items' else 'Parquet table'} of {table}")
        verb.add_argument("--output", required=True)
        verb.add_argument("--format", choices=("parquet", "json", "text", "md"), default="parquet", help="text and md write one document for each result, or for all of a search or batch")
        for option, kind, default in (("min-score", float, 0.5), ("max-candidates", int, 10), ("stages", int, 7), ("keyword", str, None), ("pattern", str, None), ("max-links", int, None), ("title", str, None), ("cross-validate", str, None)):
            verb.add_argument(f"--{option}", type=kind, default=default, **({"choices": range(1, 8)} if option == "stages" else {}))
    return parser


def _extracted(pages: DataFrame, args: argparse.Namespace) -> DataFrame:
    """One row per fetched page: the chain over its stages."""
    rows = Registry().outputs(fetches(pages), ["url"], first=args.stages)
    keyed = rows.select(F.xxhash64("url").alias("query_id"), F.lit(0).alias("url_rank"), "*")
    return select.chain(keyed, args.keyword, args.min_score).drop("query_id")


def execute(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    read = spark.read.parquet
    if args.verb == "search":
        return serp.top(serp.merge(read(args.serp)))
    if args.verb == "run":
        pages = fetches(read(args.fetches))
        previews = pages.select("url", F.substring(F.coalesce("reader_text", T.html_to_text("html")), 1, 2000).alias("preview"))
        config = pipeline.Config(max_candidates=args.max_candidates, min_completeness=args.min_score, keyword=args.keyword)
        found = pipeline.run(read(args.serp), previews, Registry().outputs(pages, ["url"], first=args.stages), config)
        return pipeline.cross_validated(found, read(args.cross_validate)) if args.cross_validate else found
    if args.verb == "extract":
        return _extracted(read(args.fetches), args)
    if args.verb == "batch":
        urls = batch.read_items(spark, args.items).where("is_url").select(F.col("item").alias("url")).distinct()
        found = _extracted(read(args.fetches).join(urls, "url", "left_semi"), args)
        return urls.select(F.col("url").alias("input")).join(found, F.col("input") == found["url"], "left")
    found = links.discover(read(args.pages), args.pattern, args.max_links)
    texts = read(args.pages).select(F.col("url").alias("abs_url"), T.html_to_text("html").alias("text"))
    return links.crawl_document(found.join(texts, "abs_url").select(F.col("page_id").alias("key"), F.col("rank").alias("idx"), "label", F.col("abs_url").alias("url"), "text"), F.lit(args.title) if args.title else None)


def rendered(result: DataFrame, args: argparse.Namespace) -> DataFrame:
    """(value): the documents that text and md ask for, one to a row."""
    md = args.format == "md"
    if args.verb == "search":
        return batch.search_report(result, args.format).select(F.col("report").alias("value"))
    if args.verb == "crawl":
        return result.select(F.col("markdown").alias("value"))
    if args.verb == "batch":
        return batch.document(result.select(F.lit(0).alias("key"), F.col("input").alias("pos"), "*"), args.format).select(F.col("document").alias("value"))
    return batch.results(result).select((batch.result_markdown() if md else F.coalesce("text", F.lit(""))).alias("value"))


def main(argv=None):
    """0 if there's a result, else 2."""
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    result = execute(spark, args)
    if args.format in ("text", "md"):
        rendered(result, args).write.mode("overwrite").text(args.output, lineSep="\n\n")
        return 0 if any(r.value for r in spark.read.text(args.output).limit(100).toLocalIterator()) else 2
    result.write.mode("overwrite").format(args.format).save(args.output)
    return 0 if not spark.read.format(args.format).load(args.output).isEmpty() else 2


if __name__ == "__main__":
    sys.exit(main())
