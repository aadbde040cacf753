"""Ordered choices: candidates, fallback chains, layers and readings of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions import classify as C
from corpusflow.functions import rx, scoring
from corpusflow.functions import text as T

#: Texts of a stage must be longer than this many characters.
STAGE_LEAST = (50, 100, 0, 100, 200, 50, 50)


def _given(rows: DataFrame, keyword: Column | str | None) -> Column | str | None:
    """The keyword given for all rows, else the rows' own column `keyword`, if they have one."""
    return F.col("keyword") if keyword is None and "keyword" in rows.columns else keyword


def verify(candidates: DataFrame, keyword: Column | str | None = None, most: int = 10, least: int = 50, early: bool = True, keyword_required: bool = False) -> DataFrame:
    """Ranked candidates of (query_id, pos, url, preview): position, quality, type and rank.

    Of the first `most` by pos, previews of under `least` visible characters go; a table of contents loses 0.3 of its
    quality; what has none left goes, and without a hit of its keyword too if that is required. With early, the scan
    ends after the first of quality 0.7 whose head has the keyword. rank: by quality, then pos. Without `keyword` each
    row's own column of that name counts, if there is one.
    """
    order = Window.partitionBy("query_id").orderBy("pos", "url")
    word = _given(candidates, keyword)
    rows = candidates.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).where(F.length(rx.strip(F.col("preview"))) >= least)
    rows = rows.withColumn("score", scoring.score_once(F.col("preview"), scoring.keyword_column(word)))
    if keyword_required and word is not None:
        word = F.coalesce(word if isinstance(word, Column) else F.lit(word), F.lit(""))
        rows = rows.where((F.col("score.keyword_density") > 0) | (word == ""))
    quality = F.col("score.quality") - F.when(F.col("score.type") == "novel_index", 0.30).otherwise(0.0)
    rows = rows.select("query_id", "pos", "url", "n", quality.alias("quality"), F.col("score.type").alias("type"), F.col("score.keyword_head_bonus").alias("head"))
    rows = rows.where(F.col("quality") > 0)
    if early:
        stop = ((F.col("quality") >= 0.7) & F.col("head")).cast("int")
        before = Window.partitionBy("query_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("stopped", F.coalesce(F.sum(stop).over(before), F.lit(0))).where("stopped = 0").drop("stopped")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("quality"), "n"))).drop("n", "head")


def content_verdict(verified: DataFrame) -> DataFrame:
    """(query_id, top_score, top_type): of the first candidate of each query that verify() leaves."""
    return verified.where("rank = 1").select("query_id", F.col("quality").alias("top_score"), F.col("type").alias("top_type"))


def judged(outputs: DataFrame, keyword: Column | str | None = None, least: float = 0.5, browser: bool = True, most_urls: int | None = None) -> DataFrame:
    """(query_id, url_rank, url, stage_index, stage_name, text) with completeness, effective, passes and stop.

    A stage counts if its text is long enough and isn't in a hidden font (stage 0), and it isn't skipped: stages 1
    and 2 are when an earlier stage of the address is complete enough, and 3 to 6 need the browser that stage 2 opens.
    A column `preview` is what the address showed before, with which a text must agree; a column `keyword` is the row's
    own one, unless one is given for all. Only the first most_urls addresses of a query are scored, and only texts that
    count are validated.
    """
    word = _given(outputs, keyword)
    if most_urls is not None:
        rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy("url_rank"))
        outputs = outputs.withColumn("nth", rank).where(F.col("nth") <= most_urls).drop("nth")
    text = F.coalesce(F.col("text"), F.lit(""))
    need = F.element_at(F.array(*[F.lit(n) for n in STAGE_LEAST]), F.least(F.col("stage_index"), F.lit(6)) + 1)
    long_enough = (F.length(text) > need) & ~((F.col("stage_index") == 0) & T.has_private_use(text))
    rows = outputs.withColumn("good", long_enough)
    rows = rows.withColumn("own", T.completeness(F.when(F.col("good"), F.col("text"))))
    here = Window.partitionBy("query_id", "url_rank").orderBy("stage_index").rowsBetween(Window.unboundedPreceding, -1)
    enough = F.coalesce(F.max(F.when(F.col("good"), F.col("own"))).over(here) >= least, F.lit(False))
    rows = rows.withColumn("enough", enough)
    url = Window.partitionBy("query_id", "url_rank")
    opened = F.coalesce(F.max(F.when(F.col("stage_index") == 2, (~F.col("enough")).cast("int"))).over(url), F.lit(0)) == 1
    rows = rows.withColumn("opened", opened & F.lit(browser))
    skipped = F.col("stage_index").isin(1, 2) & F.col("enough")
    effective = F.col("good") & ~skipped & ((F.col("stage_index") < 3) | F.col("opened"))
    rows = rows.withColumn("skipped", skipped).withColumn("effective", effective)
    only = lambda c: F.when(F.col("effective"), F.col(c))
    valid = C.validate(only("text"), only("preview") if "preview" in rows.columns else None, word, least, full=F.col("own"))["passes"]
    rows = rows.withColumn("passes", F.col("effective") & valid)
    return rows.withColumn("stop", F.col("passes") & (F.col("own") >= least)).withColumnRenamed("own", "completeness").drop("good", "enough", "opened")


def executed(rows: DataFrame) -> DataFrame:
    """The stages that run: of each query up to and with the first that stops."""
    before = Window.partitionBy("query_id").orderBy("url_rank", "stage_index").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("ended", F.coalesce(F.sum(F.col("stop").cast("int")).over(before), F.lit(0))).where("ended = 0").drop("ended")


def chain(outputs: DataFrame, keyword: Column | str | None = None, least: float = 0.5, most_urls: int = 3, browser: bool = True) -> DataFrame:
    """One row per query: the winner among passing texts, else the most complete one as best effort.

    (query_id, url, winning_stage, text, completeness, success, result, attempted, succeeded). Columns `preview` and
    `keyword` of outputs as in judged()."""
    rows = executed(judged(outputs, keyword, least, browser, most_urls))
    key = F.struct("completeness", (-F.col("url_rank")).alias("u"), (-F.col("stage_index")).alias("s"), "url", "stage_name", "text")
    best = F.max(F.when(F.col("passes") & (F.col("completeness") > 0), key))
    fallback = F.max(F.when(F.col("effective") & (F.col("completeness") > 0), key))
    done = rows.groupBy("query_id").agg(best.alias("best"), fallback.alias("fallback"), F.count(F.lit(1)).alias("attempted"), F.count_if("effective").alias("succeeded"))
    win = F.coalesce("best", "fallback")
    return done.select(
        "query_id", win["url"].alias("url"), win["stage_name"].alias("winning_stage"), F.coalesce(win["text"], F.lit("")).alias("text"),
        F.coalesce(win["completeness"], F.lit(0.0)).alias("completeness"), F.coalesce(F.col("best.completeness") >= least, F.lit(False)).alias("success"),
        F.when(F.col("best").isNotNull(), "validated").when(F.col("fallback").isNotNull(), "best_effort").otherwise("none").alias("result"), "attempted", "succeeded",
    )


def failures(outputs: DataFrame, keyword: Column | str | None = None, least: float = 0.5, most_urls: int = 3) -> DataFrame:
    """(query_id, url_rank, url, attempted, best_completeness): addresses after which there was still no valid text."""
    rows = executed(judged(outputs, keyword, least, most_urls=most_urls))
    per = rows.groupBy("query_id", "url_rank", "url").agg(F.count(F.lit(1)).alias("attempted"), F.max(F.when(F.col("effective"), F.col("completeness")).otherwise(0.0)).alias("best_completeness"), F.count_if(F.col("passes") & (F.col("completeness") > 0)).alias("ok"))
    upto = Window.partitionBy("query_id").orderBy("url_rank").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("found", F.sum("ok").over(upto)).where("found = 0").drop("found", "ok")


def pick_layer(layers: DataFrame) -> DataFrame:
    """(key, layer, text, pos) → the chosen row of each key with its tier: the first complete text by layers 1, 3, 6,
    2, 4, 5; else the longest of layers 1, 3, 6 over 100 characters; else the longest of layer 2 that isn't JSON; else
    the longest over 50. No row if there's none."""
    n = F.length(rx.strip(F.col("text")))
    place = F.array_position(F.array(*[F.lit(k) for k in (1, 3, 6, 2, 4, 5)]), F.col("layer"))
    rows = layers.where("text is not null").withColumn("n", n).withColumn("place", place).withColumn("own", scoring.completeness_once("text"))
    tier = (
        F.when((F.col("own") >= 0.5) & (F.col("place") > 0), 1)
        .when(F.col("layer").isin(1, 3, 6) & (F.col("n") > 100), 2)
        .when((F.col("layer") == 2) & ~rx.strip(F.col("text")).startswith("{") & (F.col("n") > 100), 3)
        .when(F.col("n") > 50, 4)
    )
    rows = rows.withColumn("tier", tier).where("tier is not null")
    order = [F.col("tier"), F.when(F.col("tier") == 1, F.col("place")).otherwise(-F.length("text")), F.col("pos")]
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("r = 1").drop("r", "n", "place", "own")


def first_layer(layers: DataFrame) -> DataFrame:
    """(key, layer, text, pos) → (key, layer, text): of each key the first text of over 50 visible characters, by layers
    1, 3, 6, 2, 4, 5, then pos, stripped. No row if there's none."""
    place = F.array_position(F.array(*[F.lit(k) for k in (1, 3, 6, 2, 4, 5)]), F.col("layer"))
    rows = layers.select("key", "layer", rx.strip(F.col("text")).alias("text"), "pos", place.alias("place")).where((F.col("place") > 0) & (F.length("text") > 50))
    return rows.groupBy("key").agg(F.min_by(F.struct("layer", "text"), F.struct("place", "pos")).alias("b")).select("key", "b.layer", "b.text")


def quick_or_full(layers: DataFrame) -> DataFrame:
    """The layered extraction without stages: a first layer that is complete ends it, and its text is taken; else all
    layers compete as in pick_layer(). (key, layer, text, tier), tier 0 for an early end."""
    early = layers.where((F.col("layer") == 1) & T.is_complete(F.col("text"))).groupBy("key").agg(F.min_by("text", "pos").alias("text"))
    ended = early.select("key", F.lit(1).alias("layer"), rx.strip(F.col("text")).alias("text"), F.lit(0).alias("tier"))
    rest = pick_layer(layers.join(early.select("key"), "key", "left_anti")).select("key", "layer", rx.strip(F.col("text")).alias("text"), "tier")
    return ended.unionByName(rest)


def layer_confidence(layer: Column, text: Column) -> Column:
    return F.when(layer == 1, F.when(T.completeness(text) >= 0.5, 0.9).otherwise(0.3)).when(layer == 2, F.when(F.length(text) > 50, 0.7).otherwise(0.4)).when(layer == 3, 0.8).when(layer == 4, 0.5).when(layer == 5, 0.6).otherwise(0.75)


def pick_reading(readings: DataFrame, frames: int = 5, providers: int = 2, least: float = 0.6) -> DataFrame:
    """(key, frame, provider, text, confidence) → per frame the best reading, of the first providers and frames: texts
    of over 50 characters, in provider order until one is surer than `least`; kept from `least` on. A null confidence
    is 0.6."""
    rows = readings.where((F.col("frame") < frames) & (F.col("provider") < providers) & (F.length("text") > 50)).withColumn("confidence", F.coalesce("confidence", F.lit(0.6)))
    before = Window.partitionBy("key", "frame").orderBy("provider").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("done", F.coalesce(F.max((F.col("confidence") > least).cast("int")).over(before), F.lit(0))).where("done = 0").drop("done")
    best = Window.partitionBy("key", "frame").orderBy(F.desc("confidence"), "provider")
    return rows.withColumn("r", F.row_number().over(best)).where((F.col("r") == 1) & (F.col("confidence") >= least)).drop("r")


def first_readings(readings: DataFrame, least: int = 20, separator: str = "\n\n") -> DataFrame:
    """(key, frame, provider, text) → (key, text): of each frame what the first provider gives that gives over `least`
    visible characters, joined and cleaned. With least=100 and one frame, the reading of a whole stitched page."""
    rows = readings.withColumn("text", rx.strip(F.col("text"))).where(F.length("text") > least)
    first = rows.groupBy("key", "frame").agg(F.min_by("text", "provider").alias("text"))
    return joined_readings(first, separator).withColumn("text", T.clean_ocr("text"))


def joined_readings(picked: DataFrame, separator: str = "\n---\n") -> DataFrame:
    """(key, text): the readings of a key by frame."""
    rows = picked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("frame", "text"))).alias("t"))
    return rows.select("key", F.array_join(F.col("t.text"), separator).alias("text"))


def frame_batches(frames: DataFrame, size: int = 4) -> DataFrame:
    """(key, batch, frames, count): consecutive frames in batches."""
    n = F.row_number().over(Window.partitionBy("key").orderBy("frame"))
    rows = frames.withColumn("batch", F.floor((n - 1) / size).cast("int"))
    return rows.groupBy("key", "batch").agg(F.array_sort(F.collect_list("frame")).alias("frames"), F.count(F.lit(1)).alias("count"))


def heap_string(strings: DataFrame) -> DataFrame:
    """(key, pos, text) → of the five longest strings of a key the first of 200 characters that isn't configuration
    (an object with "version" or "disable" near its start), a key file ("encryptAttrs" or "events" near it, or a long
    text that starts PG) or markup (starts < and closes a tag)."""
    rows = strings.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.length("text")), "pos"))).where("r <= 5")
    near = lambda word, n: F.substring("text", 1, n).contains(word)
    start, text = rx.strip(F.col("text")), F.col("text")
    junk = (start.startswith("{") & (near('"version"', 200) | near('"disable"', 500))) | near('"encryptAttrs"', 500) | near('"events"', 500)
    junk = junk | (start.startswith("PG") & (F.length(text) > 500)) | (start.startswith("<") & (text.contains("</") | text.contains("/>")))
    rows = rows.where((F.length("text") >= 200) & ~junk)
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("r"))).where("k = 1").drop("k", "r")


def passes_until(rows: DataFrame, least: float = 0.85, most: int = 3) -> DataFrame:
    """(key, pass, text) → the longest text of the passes up to the first complete enough, `most` at most."""
    scored = rows.where(F.col("pass") < most).withColumn("score", T.completeness("text"))
    before = Window.partitionBy("key").orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)
    run = scored.withColumn("done", F.coalesce(F.max((F.col("score") >= least).cast("int")).over(before), F.lit(0))).where("done = 0")
    return run.groupBy("key").agg(F.max(F.struct("score", (-F.col("pass")).alias("p"), "text")).alias("b"), F.count(F.lit(1)).alias("passes")).select("key", F.col("b.text").alias("text"), F.col("b.score").alias("score"), "passes")
