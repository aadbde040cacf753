"""Link discovery, chapter lists, paging and assembled crawls."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusflow.functions import rules, rx
from corpusflow.functions import text as T

_HREF = r"""href\s*=\s*["']([^"']*)["']"""
_ANCHOR = rf"(?is)<a\s[^>]*?{_HREF}[^>]*>(.*?)</a>"


def base_url(html: Column | str, url: Column | str) -> Column:
    """The page's base element's address, as written, or its own."""
    base = F.regexp_extract(html, r"(?i)<base\s[^>]*" + _HREF, 1)
    return F.when(base != "", base).otherwise(T.col(url))


@F.pandas_udf(StringType())
def _join(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b: str, h: str) -> str | None:
        try:
            return urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([None if b is None or h is None else one(b, h) for b, h in zip(base, href)], dtype=object)


def resolve(base: Column | str, href: Column | str) -> Column:
    """href against base. Absolute, host-relative and root-relative ones are native; others go through Python."""
    b, h = T.col(base), F.trim(href)
    host = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    plain = ~F.rlike(h, F.lit(r"(^|/)\.\.?(/|$|\?|#)"))
    return (
        F.when(F.rlike(h, F.lit("^https?://")) & plain, h)
        .when(h.startswith("//") & (scheme != "") & plain, F.concat(scheme, h))
        .when(h.startswith("/") & ~h.startswith("//") & (host != "") & plain, F.concat(host, h))
        .otherwise(_join(b, h))
    )


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, label): every anchor of a page in order, its label without tags."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(_ANCHOR), 1).alias("h"), F.regexp_extract_all("html", F.lit(_ANCHOR), 2).alias("t"))
    rows = pages.select("page_id", "url", base_url("html", "url").alias("base"), F.posexplode(pairs).alias("pos", "a"))
    label = rx.strip(F.regexp_replace(F.col("a.t"), "<[^>]+>", ""))
    return rows.select("page_id", "url", "base", "pos", F.trim(F.col("a.h")).alias("href"), label.alias("label"))


def discover(pages: DataFrame, pattern: str | None = None, most: int | None = None) -> DataFrame:
    """(page_id, rank, label, abs_url): the links of a page that look like chapters, or whose label or address has
    `pattern`, sorted by number. Of one address only the first anchor counts, even if its label doesn't match."""
    rows = anchors(pages).where((F.col("label") != "") & (F.col("href") != "") & ~F.lower("href").startswith("javascript:"))
    rows = rows.withColumn("abs_url", resolve("base", "href")).where(F.rlike("abs_url", F.lit("^https?://")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("page_id", "abs_url").orderBy("pos"))).where("n = 1")
    match = rx.found(F.col("label"), pattern) | rx.found(F.col("href"), pattern) if pattern else T.is_chapter_link("label")
    order = Window.partitionBy("page_id").orderBy(T.sort_key("label"), "pos")
    rows = rows.where(match).withColumn("rank", F.row_number().over(order))
    return (rows if most is None else rows.where(F.col("rank") <= most)).select("page_id", "rank", "label", "abs_url")


_HEAD = rf"第\s*([{rules._N}\d]+)\s*[章节回卷部]\s*(.*?)(?:\s|$)"


def chapter_lines(texts: DataFrame) -> DataFrame:
    """(key, base, text) → (key, rank, pos, number, title, url): the lines that head a chapter. title is the word after
    the head; the address is on the line or one of the next two, on each an absolute one before a quoted href, else it
    is guessed from the number. rank: by number, then line."""
    line = F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    rows = texts.select("key", "base", line)
    order = Window.partitionBy("key").orderBy("pos")
    ahead = [F.coalesce(F.lead("line", k).over(order), F.lit("")) for k in (1, 2)]
    rows = rows.select("*", ahead[0].alias("line1"), ahead[1].alias("line2")).where(rx.found(F.col("line"), _HEAD))
    number, title = (F.regexp_extract("line", rx.java(_HEAD), k) for k in (1, 2))
    some = lambda c: F.when(c != "", c)
    address = lambda c: F.coalesce(some(F.regexp_extract(c, rx.java("""(https?://[^\\s"']+)"""), 1)), some(F.regexp_extract(c, rx.java(r'href\s*=\s*"([^"]+)"', icase=True), 1)))
    rows = rows.withColumn("number", T.cn_number(number)).withColumn("title", F.substring(rx.strip(title), 1, 60))
    url = F.coalesce(*[address(c) for c in ("line", "line1", "line2")], some(T.chapter_url("base", "number")), F.col("base"))
    rows = rows.withColumn("url", url).withColumn("url", F.when(F.col("url").startswith("http"), F.col("url")).otherwise(resolve("base", "url")))
    return rows.select("key", F.row_number().over(Window.partitionBy("key").orderBy("number", "pos")).alias("rank"), "pos", "number", "title", "url")


def harvest(pages: DataFrame, least: int = 3) -> DataFrame:
    """(url, number, title, chapter_url): the numbered chapters that a contents page links to, each number once and
    where it comes first, of pages that have at least `least`; by number. Scripts are no links."""
    rows = anchors(pages).withColumn("n", F.regexp_extract("label", rx.java(rf"第\s*([{rules._N}\d]+)\s*章"), 1))
    rows = rows.where((F.col("n") != "") & (F.col("href") != "") & ~F.col("href").startswith("javascript:")).withColumn("number", T.cn_number("n"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("url", "number").orderBy("pos"))).where("k = 1")
    rows = rows.withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("url"))).where(F.col("found") >= least)
    return rows.select("url", "number", F.col("label").alias("title"), resolve("url", "href").alias("chapter_url"))


def first_chapter(pages: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(url, title, chapter_url): the first chapter that a contents page leads to: the first anchor whose label heads
    one, else the chapter of least number among the lines of the page's text (texts: url, text)."""
    heads = rx.found(F.col("label"), rf"第[{rules._N}\d]+[章节回卷部]")
    rows = anchors(pages).where(heads & (F.col("href") != "")).groupBy("url").agg(F.min_by(F.struct("label", "href"), "pos").alias("a"))
    address = F.when(F.col("a.href").startswith("http"), F.col("a.href")).otherwise(resolve("url", "a.href"))
    found = rows.select("url", F.substring(rx.strip(F.col("a.label")), 1, 60).alias("title"), address.alias("chapter_url"))
    if texts is None:
        return found
    rest = texts.join(found.select("url"), "url", "left_anti").select(F.col("url").alias("key"), F.col("url").alias("base"), "text")
    lines = chapter_lines(rest).where("rank = 1").select(F.col("key").alias("url"), F.concat(F.lit("第"), F.col("number").cast("string"), F.lit("章 "), "title").alias("title"), F.col("url").alias("chapter_url"))
    return found.unionByName(lines)


def followed_chapter(indexes: DataFrame, chapters: DataFrame) -> DataFrame:
    """indexes (url, text, type, chapter_url) and chapters (chapter_url, text) → (url, text, score): a table of contents
    gives way to its first chapter if that has over half as many characters."""
    is_index = (F.col("type") == "novel_index") | T.looks_like_index("text")
    rows = indexes.join(chapters.select("chapter_url", F.col("text").alias("chapter")), "chapter_url", "left")
    better = is_index & (F.length("chapter") > F.length("text") * 0.5)
    rows = rows.select(F.when(better, F.coalesce("chapter_url", "url")).otherwise(F.col("url")).alias("url"), F.when(better, F.col("chapter")).otherwise(F.col("text")).alias("text"))
    return rows.select("url", "text", T.completeness("text").alias("score"))


def page_links(pages: DataFrame) -> DataFrame:
    """(url, next_page, next_chapter): the first link of each kind, null if there's none."""
    rows = anchors(pages).where((F.col("href") != "") & (F.col("href") != "#") & ~F.col("href").startswith("javascript:"))
    first = lambda c: F.min_by("href", F.when(c, F.col("pos")))
    page, chapter = F.rlike("label", F.lit(r"^(下一页|下一頁)$")), F.rlike("label", F.lit("下一章|下一节"))
    return rows.groupBy("url").agg(first(page).alias("next_page"), first(chapter).alias("next_chapter"))


def follow(nav: DataFrame, texts: DataFrame, most: int = 10) -> DataFrame:
    """(start, pages, text): from every address along next_page, until there's none, a page that leads to the next
    chapter, a page that comes again, or `most` pages. nav: (url, next_page, next_chapter), absolute; texts: (url, text).
    Pages lose what follows a site's buttons; empty ones are left out. Two blank lines part pages.

    The walk doubles: what 2^k steps lead to is joined with itself, so ten pages take four joins and not nine.
    """
    ends = F.coalesce(F.col("next_chapter"), F.lit("")) != "" if "next_chapter" in nav.columns else F.lit(False)
    edges = nav.where(~ends & F.col("next_page").isNotNull()).groupBy("url").agg(F.min("next_page").alias("next_page"))
    paths = nav.select("url").distinct().join(edges, "url", "left").select("url", F.array_compact(F.array("url", F.when(F.col("next_page") != F.col("url"), F.col("next_page")))).alias("path"))
    size = 2
    while size < most + 1:  # path: up to `size` addresses from url on, cut before the first that comes again
        on = paths.select(F.col("url").alias("last"), F.col("path").alias("more"))
        joined = paths.withColumn("last", F.element_at("path", -1)).join(on, "last", "left")
        going = F.size("path") == size
        both = F.when(going, F.concat("path", F.coalesce(F.slice("more", F.lit(2), F.greatest(F.size("more") - 1, F.lit(0))), F.array().cast("array<string>")))).otherwise(F.col("path"))
        paths = joined.select("url", both.alias("path"))
        again = F.array_min(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.when(F.array_position("path", F.get("path", i - 1)) < i, i)))
        paths = paths.select("url", F.when(again.isNotNull(), F.slice("path", F.lit(1), again - 1)).otherwise(F.col("path")).alias("path"))
        size = 2 * size - 1
    step = paths.select(F.col("url").alias("start"), F.posexplode(F.slice("path", 1, most)).alias("k", "url"))
    step = step.join(texts.select("url", T.strip_page_tail("text").alias("t")), "url", "left")
    rows = step.groupBy("start").agg(F.count(F.lit(1)).cast("int").alias("pages"), F.array_sort(F.collect_list(F.struct("k", F.coalesce("t", F.lit("")).alias("t")))).alias("p"))
    return rows.select("start", "pages", F.array_join(F.filter(F.col("p.t"), lambda x: x != ""), "\n\n").alias("text"))


def crawl_document(items: DataFrame, title: Column | None = None) -> DataFrame:
    """(key, idx, label, url, text) → (key, total, extracted, failed, total_chars, markdown): items with over 100
    characters, in order, under one heading. Of items with one slug the first counts; total counts slugs and failed
    those that gave too little."""
    slug = T.slug("label", "idx")
    rows = items.withColumn("slug", slug)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("key", "slug").orderBy("idx"))).where("n = 1")
    good = F.length("text") > 100
    book = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(good).alias("extracted"), F.coalesce(F.sum(F.when(good, F.length("text"))), F.lit(0)).alias("total_chars"),
        F.array_sort(F.collect_list(F.when(good, F.struct("idx", "label", "url", "text")))).alias("i"), F.min_by("url", "idx").alias("first_url"),
    )
    first = F.get("i", F.lit(0))
    name = T.guess_title(F.coalesce(first["label"], F.lit("")), F.col("first_url")) if title is None else title
    line = F.concat(F.lit("共 "), F.col("extracted").cast("string"), F.lit(" 篇 | 总字数约 "), F.format_number(F.col("total_chars"), 0), F.lit(" | 来源："), T.domain("first_url"), F.lit("\n\n---\n\n"))
    head = F.concat(F.lit("# "), name, F.lit("\n\n"), F.when(F.col("total_chars") > 0, line).otherwise(""))
    parts = F.transform("i", lambda x: F.concat(F.lit("## "), x["label"], F.lit("\n\n"), x["text"], F.lit("\n\n---\n\n")))
    return book.select("key", "total", "extracted", (F.col("total") - F.col("extracted")).alias("failed"), "total_chars", F.concat(head, F.array_join(parts, "")).alias("markdown"))


def remaining(links: DataFrame, done: DataFrame, key: str = "abs_url") -> DataFrame:
    """Links that an earlier crawl hasn't done."""
    return links.join(done.select(key).distinct(), key, "left_anti")
