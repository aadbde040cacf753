"""Token counts: the exact histogram of encoded lengths."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.common import table

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


@cache
def _encoder(vocabulary: str, pattern: str):
    """One encoder per Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_tokenizer() -> tuple[str, str]:
    """Path and split pattern of the byte-level BPE vocabulary among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


#: What a pattern ends with whose white space can be cut out of a text, and a run that is long enough to be.
_BLANKS = r"\s+(?!\S)|\s+"
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def tokens_in(encoder, text: str) -> int:
    """How many tokens a text has. The encoder's regular expression overflows its stack in very long runs of white
    space, so these are cut out where the pattern would: all of a run at the end of the text, else all but its last
    character, is one piece."""
    count, at = 0, 0
    for run in _RUN.finditer(text) if encoder._pat_str.endswith(_BLANKS) else ():
        start, stop = run.start(), run.end() - (run.end() < len(text))
        count += len(encoder.encode_ordinary(text[at:start])) + len(encoder._encode_single_piece(text[start:stop].encode()))
        at = stop
    return count + len(encoder.encode_ordinary(text[at:] if at else text))


def encoded_lengths(documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, tokens): how many tokens each whole text has; 0 for a null or empty one. Special tokens' strings are
    ordinary text. vocabulary is a path that every executor can read. doc_id may have any type and be null; repeated
    rows are each counted, an empty table gives no rows, other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, pattern)
        for batch in batches:
            lengths = [tokens_in(encoder, t.as_py()) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], names=["doc_id", "tokens"])

    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("tokens", T.LongType())]))


def length_histogram(lengths: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """One row per distinct length in tokens of lengths, which is all that any context limit can tell apart.

    For limit = length: docs and tokens (of exactly this length), docs_upto, tokens_upto, docs_from (suffix sum of
    docs, this length and longer), tokens_from, truncated_total (tokens that stay when every document is cut to limit
    tokens: tokens_upto + limit * docs longer) and quantiles, the given ones for which this is the nearest-rank value
    (empty string if none). at_limit() answers limits between rows. Sums are exact 64-bit integers.

    Every row counts, repeated ones and those with null ids too; null lengths are left out; an empty table gives no
    rows. Only (length, docs) is shuffled; the running sums see one row per distinct length, so their single
    partition holds at most as many rows as the longest document has tokens.
    """
    counts = lengths.where("tokens is not null").groupBy(F.col("tokens").alias("length")).agg(F.count(F.lit(1)).alias("docs"))
    one = Window.partitionBy(F.lit(0))
    upto = one.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"))
    rows = rows.select("*", F.sum("docs").over(upto).alias("docs_upto"), F.sum("tokens").over(upto).alias("tokens_upto"), F.sum("docs").over(one).alias("n"), F.sum("tokens").over(one).alias("total"))
    marks = F.concat_ws(",", *[F.when((F.ceil(F.lit(q) * F.col("n")) <= F.col("docs_upto")) & (F.ceil(F.lit(q) * F.col("n")) > F.col("docs_upto") - F.col("docs")), F.lit(str(q))) for q in quantiles])
    return rows.select(
        "length", "docs", "tokens", "docs_upto", "tokens_upto",
        (F.col("n") - F.col("docs_upto") + F.col("docs")).alias("docs_from"),
        (F.col("total") - F.col("tokens_upto") + F.col("tokens")).alias("tokens_from"),
        (F.col("tokens_upto") + F.col("length") * (F.col("n") - F.col("docs_upto"))).alias("truncated_total"),
        marks.alias("quantiles"),
    )


def at_limit(histogram: DataFrame, limit: int) -> DataFrame:
    """(limit, docs_within, docs_cut, truncated_total) for one context limit, from the histogram alone; zeros where the
    histogram is empty. Other columns of the histogram are not read."""
    within = F.col("length") <= limit
    n = F.coalesce(F.sum(F.when(within, F.col("docs"))), F.lit(0))
    longer = F.coalesce(F.sum(F.when(~within, F.col("docs"))), F.lit(0))
    return histogram.agg(n.alias("docs_within"), longer.alias("docs_cut"), (F.coalesce(F.sum(F.when(within, F.col("tokens"))), F.lit(0)) + limit * longer).alias("truncated_total")).select(F.lit(limit).alias("limit"), "*")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents"), *default_tokenizer()))


QUERIES = {"op8_token_counts": op8_token_counts}
SQL: dict[str, str] = {}
