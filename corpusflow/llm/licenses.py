"""License scans: an exact set-similarity join of text blocks with license notices."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.common import small_broadcast, table

#: Public notices, one block each.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-grant": "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "lgpl": "This library is licensed under the GNU Lesser General Public License",
    "agpl-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-4.0": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
}
_WORD = re.compile(r"[^\W_]+")
_BLANK = re.compile(r"\n(?:[ \t\r]*\n)+")


def tokens(text: str) -> list[str]:
    return list(dict.fromkeys(_WORD.findall(text.lower())))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):  # few texts at a time are Python strings
            batch = whole.slice(at, 500)
            yield batch.column(0), batch.column(1).to_pylist()


def _counted(documents: DataFrame, vocabulary: frozenset[str]) -> DataFrame:
    """(token, n): in how many lines the vocabulary's tokens occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for _, texts in _texts(batches):
            for text in texts:
                for line in text.lower().split("\n"):
                    found.update(vocabulary.intersection(_WORD.findall(line)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["token", "n"])

    return documents.where("text is not null").select("doc_id", "text").mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _blocks(documents: DataFrame, rank: dict[str, int], prefix: frozenset[str]) -> DataFrame:
    """(doc_id, kind, block_no, block, block_tokens, b) of the blocks that hold one of the prefix tokens; b has their
    tokens that are ranked, in this order."""
    kind = documents.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            rows: list[tuple] = []
            for i, text in enumerate(texts):
                if prefix.isdisjoint(_WORD.findall(text.lower())):
                    continue
                lines = ((i, "line", k, x) for k, x in enumerate(text.split("\n")))
                for *where, block in chain(lines, ((i, "paragraph", k, x) for k, x in enumerate(_BLANK.split(text)) if "\n" in x)):
                    held = set(_WORD.findall(block.lower()))
                    if not prefix.isdisjoint(held):
                        rows.append((*where, block, len(held), sorted(held.intersection(rank), key=rank.__getitem__)))
            if rows:
                at, kinds, numbers, blocks, sizes, b = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(kinds), pa.array(numbers, pa.int32()), pa.array(blocks), pa.array(sizes, pa.int32()), pa.array(b, pa.list_(pa.string()))], names=["doc_id", "kind", "block_no", "block", "block_tokens", "b"])

    rows = documents.where("text is not null").select("doc_id", "text")
    return rows.mapInArrow(run, T.StructType([kind, *T.StructType.fromDDL("kind string, block_no int, block string, block_tokens int, b array<string>").fields]))


def license_scan(documents: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """(doc_id, kind, block_no, template, overlap, template_tokens, block_tokens, block) for every block that holds at
    least the share `threshold` of a template's distinct tokens (lowered runs of letters and digits, so comment marks
    don't count). Blocks are the lines of a text (kind "line") and, for notices wrapped over lines, its paragraphs of two
    or more lines (kind "paragraph"), which blank lines part; block_no counts each kind from 0, paragraphs of one line
    too. A block may meet several templates, and each is reported; so are a line and the paragraph that has it.

    Tokens are ordered by how many lines of the corpus hold them, rarest first, then by themselves. A block must hold
    one of the template's first |t| - a + 1 tokens, a = ceil(threshold |t|) (prefix filter), at least a template tokens
    (length filter) and, behind the first shared token, enough tokens of both to reach a (positional filter); what is
    left is counted. All filters are lossless, and tokens that no template has can't add to an overlap, so blocks are
    reduced to the templates' vocabulary first.

    A null doc_id is carried, and doc_id keeps its type; null and empty texts have no block; texts of any length are
    read whole; repeated rows are each reported; other columns are not read; an empty table gives no rows. Nothing is
    shuffled but token counts, one per token of the templates: two scans, with the templates broadcast while they are
    under 32 MB.
    """
    sets = {name: tokens(text) for name, text in (TEMPLATES if templates is None else templates).items()}
    sets = {name: found for name, found in sets.items() if found}
    vocabulary = sorted({t for found in sets.values() for t in found})
    spark = documents.sparkSession
    out = T.StructType([documents.schema["doc_id"], *T.StructType.fromDDL("kind string, block_no int, template string, overlap int, template_tokens int, block_tokens int, block string").fields])
    if not vocabulary:
        return spark.createDataFrame([], out)

    frequency = {r.token: r.n for r in _counted(documents, frozenset(vocabulary)).collect()}  # at most the templates' vocabulary
    rank = {t: k for k, t in enumerate(sorted(vocabulary, key=lambda t: (frequency.get(t, 0), t)))}
    index, whole = [], []
    for name, found in sets.items():
        ordered = sorted(found, key=rank.__getitem__)
        need = math.ceil(threshold * len(ordered) - 1e-9)
        whole.append((name, ordered, need))
        index += [(ordered[i], name, i, need) for i in range(len(ordered) - max(need, 1) + 1)]
    prefixes = small_broadcast(spark.createDataFrame(index, "token string, template string, i int, need int"), len(index), 200)
    wholes = small_broadcast(spark.createDataFrame([(n, o) for n, o, _ in whole], "template string, ordered array<string>"), sum(len(o) for _, o, _ in whole), 60)
    reduced = _blocks(documents, rank, frozenset(x[0] for x in index))
    pairs = reduced.select("doc_id", "kind", "block_no", "block", "block_tokens", "b", F.posexplode("b").alias("j", "token")).join(prefixes, "token").where(F.size("b") >= F.col("need"))
    pairs = pairs.join(wholes, "template")
    first = F.size(F.array_intersect(F.slice("ordered", F.lit(1), F.col("i")), "b")) == 0
    bound = F.least(F.size("ordered") - F.col("i"), F.size("b") - F.col("j")) >= F.col("need")
    shared = F.size(F.array_intersect("ordered", "b"))
    return pairs.where(bound & first).select("doc_id", "kind", "block_no", "template", shared.alias("overlap"), F.size("ordered").alias("template_tokens"), "block_tokens", "block", "need").where("overlap >= need").drop("need")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join(f"('{name}', {tokens(text)!r})" for name, text in TEMPLATES.items())
    return f"""
        WITH t(template, words) AS (VALUES {rows}),
        blocks AS (
            SELECT doc_id, 'line' AS kind, unnest(range(len(string_split(text, chr(10))))) AS block_no, unnest(string_split(text, chr(10))) AS block
            FROM documents
            UNION ALL
            SELECT * FROM (
                SELECT doc_id, 'paragraph' AS kind, unnest(range(len(string_split_regex(text, '{_BLANK.pattern}')))) AS block_no, unnest(string_split_regex(text, '{_BLANK.pattern}')) AS block
                FROM documents
            ) WHERE contains(block, chr(10))
        ), b AS (
            SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(block), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS found FROM blocks
        ), m AS (
            SELECT doc_id, kind, block_no, template, len(list_intersect(words, found)) AS overlap, len(words) AS n, len(found) AS k, block FROM b CROSS JOIN t
        )
        SELECT doc_id, kind, CAST(block_no AS INTEGER) AS block_no, template, CAST(overlap AS INTEGER) AS overlap,
               CAST(n AS INTEGER) AS template_tokens, CAST(k AS INTEGER) AS block_tokens, block
        FROM m WHERE overlap >= ceil(0.8 * n - 1e-9)
    """


QUERIES = {"op4_license_scan": op4_license_scan}
SQL = {"op4_license_scan": _sql()}
