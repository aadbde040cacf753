"""Chapters of several sources: alignment, merging, differences and cleaning."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusflow.functions import rx
from corpusflow.functions import text as T


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """The matching-blocks ratio of two short strings, in Python."""
    return _ratio.asNondeterministic()(a, b)


def eligible_sources(sources: DataFrame, most: int = 3) -> DataFrame:
    """(work_id, pos, url, preview) → the first `most` of a work that show plain text of 500 characters and five
    chapter marks."""
    marks = rx.count(F.col("preview"), r"第[一二三四五六七八九十百千\d]+[章节回]")
    rows = sources.where(~T.has_private_use("preview") & (F.length("preview") >= 500) & (marks >= 5))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("work_id").orderBy("pos"))).where(F.col("n") <= most)


class _Bounds:
    """Upper bounds of the ratios of some strings to another: matching blocks make a common subsequence, so a ratio is at
    most twice the longest one's length by both lengths. All strings' bits lie in one integer, each string's with a free
    bit above, and a character of the other string takes one step in all of them."""

    def __init__(self, texts: list[str]) -> None:
        self.sizes = np.array([len(t) for t in texts])
        self.width = (int(self.sizes.max(initial=0)) // 8 + 1) * 8
        codes = np.full((len(texts), self.width), -1, np.int64)
        for row, t in zip(codes, texts):
            row[: len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        packed = lambda held: int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")
        self.full = packed(codes >= 0)
        self.held = {chr(c): packed(codes == c) for c in np.unique(codes[codes >= 0]).tolist()}

    def of(self, other: str) -> np.ndarray:
        left, full = self.full, self.full
        for here in map(self.held.get, other):
            if here and (met := left & here):
                left = ((left + met) | (left - met)) & full
        bits = np.frombuffer(left.to_bytes(len(self.sizes) * self.width // 8, "little"), np.uint8).reshape(len(self.sizes), -1)
        common = self.sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        return 2.0 * common / np.maximum(self.sizes + len(other), 1)


def closest(texts: list[str], others: list[str], groups: list[str], least: float) -> list[tuple[int, int, float]]:
    """(i, j, ratio): to each text the other of each group of the highest ratio of at least `least`, the first of equals.
    A ratio is worked out only where its bound reaches `least` and the highest so far."""
    if not texts or not others:
        return []
    bounds = _Bounds(texts)
    most = np.stack([bounds.of(o) for o in others], axis=1)
    matchers: dict[int, SequenceMatcher] = {}
    found = []
    for group in dict.fromkeys(groups):
        own = np.array([j for j, g in enumerate(groups) if g == group])
        for i in np.flatnonzero((most[:, own] >= least).any(axis=1)).tolist():
            row, best, at = most[i, own], -1.0, -1
            for k in np.lexsort((own, -row))[: int((row >= least).sum())].tolist():
                j = int(own[k])
                if row[k] < best:
                    break
                if row[k] == best and j > at:
                    continue
                if j not in matchers:
                    matchers[j] = SequenceMatcher(None, "", others[j])
                matchers[j].set_seq1(texts[i])
                r = matchers[j].ratio()
                if r >= least and (r > best or (r == best and j < at)):
                    best, at = r, j
            if at >= 0:
                found.append((i, at, best))
    return found


def _closest_of(least: float) -> Callable[..., Column]:
    kind = pa.list_(pa.struct({"i": pa.int32(), "j": pa.int32(), "ratio": pa.float64()}))

    def run(texts: pa.Array, others: pa.Array, groups: pa.Array) -> pa.Array:
        rows = (closest(a.as_py(), b.as_py(), g.as_py(), least) for a, b, g in zip(texts, others, groups))
        return pa.array([[{"i": i, "j": j, "ratio": r} for i, j, r in row] for row in rows], kind)

    # once a row: filters that explode() brings along would each call it again
    return F.arrow_udf(run, "array<struct<i: int, j: int, ratio: double>>").asNondeterministic()


def align(chapters: DataFrame, least: float = 0.60, block: int = 64, blocks: int = 16) -> DataFrame:
    """(work_id, row, source_idx, ordinal): chapters (work_id, source_idx, ordinal, text) in rows of the same chapter.

    The source with the most chapters is the base (the first of equals); each of its chapters is a row, to which every
    other source gives its most similar chapter of a ratio of at least `least` (the earliest of equals; one may serve
    several rows). Chapters that serve none follow as rows of their own, by source and order. Similarity: the ratio of
    fingerprints. Only fingerprints reach Python, `block` of the base's and as many others' at a time; the work of over
    `blocks` such blocks of the base is shared by several tasks.
    """
    own, work = Window.partitionBy("work_id", "source_idx"), Window.partitionBy("work_id")
    rows = chapters.where("work_id is not null").select("work_id", "source_idx", "ordinal", T.fingerprint(F.coalesce("text", F.lit(""))).alias("print"))
    rows = rows.withColumn("row", F.row_number().over(own.orderBy("ordinal"))).withColumn("n", F.count(F.lit(1)).over(own))
    rows = rows.withColumn("base", F.max(F.struct("n", (-F.col("source_idx")).alias("s"), "source_idx")).over(work))
    one, two = rows.where("source_idx = base.source_idx"), rows.where("source_idx != base.source_idx")
    turn = lambda n, size: F.floor((n - 1) / size).cast("int")
    sliced = ["work_id", "slice"]
    texts = one.where("print != ''").select("work_id", turn(F.col("row"), block * blocks).alias("slice"), turn(F.col("row"), block).alias("block"), F.struct("row", "print").alias("a"))
    texts = texts.groupBy(*sliced, "block").agg(F.array_sort(F.collect_list("a")).alias("a")).drop("block")
    place = F.row_number().over(work.orderBy("source_idx", "row"))
    others = two.withColumn("place", place).where("print != ''").select("work_id", F.col("base.n").alias("last"), turn(F.col("place"), block).alias("block"), F.struct("place", "source_idx", "ordinal", "print").alias("b"))
    others = others.groupBy("work_id", "block").agg(F.array_sort(F.collect_list("b")).alias("b"), F.first("last").alias("last"))
    others = others.select("work_id", F.explode(F.sequence(F.lit(0), turn(F.col("last"), block * blocks))).alias("slice"), "b")
    # a number of its own: by their bytes, little against the work on them, the blocks would be put together in a few tasks
    spread = lambda d: d.repartition(int(chapters.sparkSession.conf.get("spark.sql.shuffle.partitions")), *sliced)
    found = spread(texts).hint("merge").join(spread(others), sliced).withColumn("hits", _closest_of(least)("a.print", "b.print", F.col("b.source_idx").cast("array<string>")))
    hits = found.select("work_id", "a", "b", F.explode("hits").alias("h")).select("work_id", F.get("a", F.col("h.i"))["row"].alias("row"), F.get("b", F.col("h.j")).alias("b"), "h.ratio")
    best = Window.partitionBy("work_id", "row", "b.source_idx").orderBy(F.desc("ratio"), "b.place")
    matched = hits.withColumn("r", F.row_number().over(best)).where("r = 1").select("work_id", "row", "b.source_idx", "b.ordinal", F.lit(None).cast("bigint").alias("last"))
    # the others follow as candidates for rows of their own; one that serves a row is known by the rows beside it
    rest = two.select("work_id", F.lit(None).cast("int").alias("row"), "source_idx", "ordinal", F.col("base.n").alias("last"))
    used = F.max("row").over(Window.partitionBy("work_id", "source_idx", "ordinal"))
    placed = matched.unionByName(rest).withColumn("used", F.col("last").isNotNull() & used.isNull()).where("row is not null or used")
    after = F.sum(F.col("used").cast("int")).over(work.orderBy("source_idx", "ordinal").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.select("work_id", F.coalesce("row", F.col("last") + after).cast("int").alias("row"), "source_idx", "ordinal")
    return one.select("work_id", "row", "source_idx", "ordinal").unionByName(placed)


def merge(rows: DataFrame, strategy: str = "longest") -> DataFrame:
    """(work_id, row, source_idx, source_name, title, text) → (work_id, num, title, text, sources, confidence).

    longest; most_consistent (nearest to the upper median length); voting (of more than two, the most similar to the
    others). Texts over 1.3 times the chosen one's length are appended as supplements; sources are the chosen one's and
    theirs. The text is stripped. Confidence 1 for one source, 0.9 for several, 0.7 with a supplement.
    """
    rows = rows.where(F.length("text") > 0).withColumn("chars", F.length("text"))
    key = Window.partitionBy("work_id", "row")
    if strategy == "longest":
        order = [F.desc("chars"), F.asc("source_idx")]
    elif strategy == "most_consistent":
        sizes = F.sort_array(F.collect_list("chars").over(key))
        rows = rows.withColumn("gap", F.abs(F.col("chars") - F.get(sizes, F.floor(F.size(sizes) / 2).cast("int"))))
        order = [F.asc("gap"), F.asc("source_idx")]
    elif strategy == "voting":
        a, b = (rows.select("work_id", "row", F.col("source_idx").alias(f"i{k}"), T.fingerprint("text").alias(f"t{k}")) for k in "ab")
        votes = a.join(b, ["work_id", "row"]).where("ia != ib").withColumn("r", ratio(F.col("ta"), F.col("tb")))
        votes = votes.groupBy("work_id", "row", F.col("ia").alias("source_idx")).agg(F.sum("r").alias("votes"))
        rows = rows.join(votes, ["work_id", "row", "source_idx"], "left").withColumn("k", F.count(F.lit(1)).over(key))
        order = [F.when(F.col("k") > 2, F.col("votes")).desc(), F.desc("chars"), F.asc("source_idx")]
    else:
        raise ValueError(strategy)
    rows = rows.withColumn("n", F.row_number().over(key.orderBy(*order)))
    best = lambda c: F.max(F.when(F.col("n") == 1, F.col(c)))
    out = rows.groupBy("work_id", "row").agg(
        best("title").alias("title"), best("text").alias("text"), best("chars").alias("chars"), best("source_name").alias("name"), F.count(F.lit(1)).alias("k"),
        F.array_sort(F.collect_list(F.struct("source_idx", "source_name", "chars", "text", "n"))).alias("all"),
    )
    more = F.filter("all", lambda x: (x["n"] > 1) & (x["chars"] > F.col("chars") * 1.3))
    added = F.transform(more, lambda x: F.concat(F.lit("\n\n[补充内容 from "), x["source_name"], F.lit("]\n"), x["text"]))
    text = rx.strip(rx.shorter_gaps(F.concat("text", F.array_join(added, ""))))
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.format_string("第%d章", F.col("row")))
    sure = F.when(F.col("k") == 1, 1.0).when(F.size(more) > 0, 0.7).otherwise(0.9)
    return out.select("work_id", F.col("row").alias("num"), title.alias("title"), text.alias("text"), F.concat(F.array("name"), F.transform(more, lambda x: x["source_name"])).alias("sources"), sure.alias("confidence"))


def differences(rows: DataFrame) -> DataFrame:
    """(work_id, row, kind, a, b): rows whose longest text is over 1.5 times the shortest, else each pair of texts of
    a ratio under 0.5."""
    rows = rows.where(F.length("text") > 0).select("work_id", "row", "source_idx", F.length("text").alias("chars"), T.fingerprint("text").alias("print"))
    span = rows.groupBy("work_id", "row").agg(F.max("chars").alias("most"), F.min("chars").alias("least"), F.count(F.lit(1)).alias("k"), F.min_by("source_idx", F.struct("chars", "source_idx")).alias("a"), F.max_by("source_idx", F.struct("chars", -F.col("source_idx"))).alias("b")).where("k >= 2")
    apart = F.col("most") > F.col("least") * 1.5
    long = span.where(apart).select("work_id", "row", F.lit("char_count").alias("kind"), "a", "b")
    left = rows.join(span.where(~apart).select("work_id", "row"), ["work_id", "row"])
    one, two = (left.select("work_id", "row", F.col("source_idx").alias(k), F.col("print").alias(f"p{k}")) for k in "ab")
    low = one.join(two, ["work_id", "row"]).where("a < b").withColumn("r", ratio(F.col("pa"), F.col("pb"))).where("r < 0.5")
    return long.unionByName(low.select("work_id", "row", F.lit("low_similarity").alias("kind"), "a", "b"))


def summary(merged: DataFrame) -> DataFrame:
    """(work_id, chapters, total_chars, confidence)."""
    return merged.groupBy("work_id").agg(F.count(F.lit(1)).alias("chapters"), F.sum(F.length("text")).alias("total_chars"), F.avg("confidence").alias("confidence"))


def auto_clean(texts: DataFrame, tail: int = 800) -> DataFrame:
    """(key, text) → text without the tails that its parts share. Parts lie between ruled chapter heads; with three
    heads or more, of the three commonest last 800 characters those that at least three and half of the parts end
    with are removed wherever they occur. Runs of line ends shrink."""
    parts = texts.select("key", F.posexplode(F.split("text", r"={10,}\n第\p{Nd}+章\n={10,}", -1)).alias("pos", "part"))
    stripped = rx.strip(F.col("part"))
    tails = parts.select("key", F.substr(stripped, F.greatest(F.length(stripped) - tail + 1, F.lit(1))).alias("tail"), "pos")
    count = tails.groupBy("key", "tail").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("at"))
    size = parts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    top = count.join(size, "key").withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("c"), "at"))).where((F.col("r") <= 3) & (F.col("c") >= F.greatest(F.lit(3.0), F.col("n") * 0.5)) & (F.col("tail") != ""))
    gone = top.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r", "tail"))).alias("g"))
    cleaned = F.aggregate(F.coalesce(F.col("g.tail"), F.array().cast("array<string>")), F.col("text"), lambda t, x: F.replace(t, x, F.lit("")))
    out = texts.join(gone, "key", "left").join(size, "key", "left")
    return out.select("key", F.when(F.col("n").isNotNull(), rx.shorter_gaps(cleaned)).otherwise(F.col("text")).alias("text"))
