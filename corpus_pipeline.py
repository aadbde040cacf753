"""The corpus pipeline: toxicity, exact dedup, near dedup, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm.common import remove, shared_folder, table
from corpusflow.llm.exact_dedup import exact_dedup
from corpusflow.llm.jaccard import keep_one
from corpusflow.llm.packing import pack
from corpusflow.llm.toxicity import keep_clean, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier rejects; it is trained on the labelled rows of docs. Null and empty texts
    stay, long ones are scored whole, of repeated rows all stay or all go; an empty table, and one without labels of both
    kinds, stays as it is."""
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels"))).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each text, the one of the least doc_id; null texts all stay, else as exact_dedup() says."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group that the n-gram Jaccard join connects, the least doc_id. Null doc_ids, null
    texts and texts without words stay, else as keep_one() says."""
    return keep_one(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packs made of docs; what becomes of nulls, empty and long texts is said at pack()."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("packing", pack_windows),
]

#: SQL can't express the classifier, the sampled join or the least squares; tests compare each with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written to the session's shared folder and read again. A
    stage's table is removed once the next one's is written, so that only the last, which the result reads, stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
