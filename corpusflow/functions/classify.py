"""Classifiers of addresses, texts and pages, and the acceptance checks."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions import rules, rx, scoring
from corpusflow.functions import text as T
from corpusflow.functions.text import col


def _first(pairs: list[tuple[Column, str]]) -> Column:
    out = F.when(pairs[0][0], pairs[0][1])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out


def url_type(url: Column | str) -> Column:
    """What an address's parts say about its content; the first family that matches."""
    u = F.lower(url)
    has = lambda words: reduce(or_, [u.contains(w) for w in words])
    (_, novel), *others = rules.ADDRESSES
    out = F.when(
        has(novel),
        F.when(F.rlike(u, F.lit(r"/\p{Nd}+(_?\p{Nd}+)?\.html?")), "novel_chapter").when(F.rlike(u, F.lit("/(index|list|catalog|menu|dir)")), "novel_index").otherwise("novel_chapter"),
    )
    for kind, words in others:
        out = out.when(has(words), kind)
    return out.otherwise("unknown")


def classify_url(url: Column | str) -> Column:
    """struct(is_content, type, confidence, reason): noise by the first strong pattern, or by three weak ones."""
    # inside let() expressions are interpreted: sixty-odd patterns would not fit into one generated method
    return T.let(col(url), lambda u: T.let(F.struct(_strong(u).alias("strong"), _weak(u).alias("weak")), lambda v: _verdict(u, v["strong"], v["weak"])))


def _strong(u: Column) -> Column:
    return _first([(rx.found(u, p, icase=True), p) for p in rules.NOISE_HIGH])


def _weak(u: Column) -> Column:
    return reduce(add, [rx.found(u, p, icase=True).cast("int") for p in rules.NOISE_MID])


def _verdict(u: Column, strong: Column, weak: Column) -> Column:
    verdict = lambda good, kind, sure, why: F.struct(F.lit(good).alias("is_content"), kind.alias("type"), F.lit(sure).alias("confidence"), why.alias("reason"))
    return (
        F.when(strong.isNotNull(), verdict(False, F.lit("noise_high"), 0.95, F.concat(F.lit("matched:"), strong)))
        .when(weak >= 3, verdict(False, F.lit("noise_mid_multi"), 0.7, F.concat(F.lit("mid hits: "), weak.cast("string"))))
        .when(weak >= 1, verdict(True, F.lit("uncertain"), 0.4, F.concat(F.lit("mid hits: "), weak.cast("string"))))
        .otherwise(verdict(True, url_type(u), 0.65, F.lit("clean URL")))
    )


def is_likely_content(url: Column | str) -> Column:
    return ~reduce(or_, [rx.found(col(url), p, icase=True) for p in rules.UNLIKELY])


def content_type(text: Column | str) -> Column:
    """struct(type, score): the signature with the highest positive score, the earlier one at ties; else unknown, 0."""
    return scoring.content_type_of(col(text))


def match_keywords(text: Column | str, keyword: Column | str) -> Column:
    """struct(hits, density, head_bonus, matches, positions) of the words of keyword, which may be a column."""
    return scoring.match_of(col(text), scoring.keyword_column(keyword))


def score_content(text: Column | str, keyword: Column | str | None = None) -> Column:
    """struct(quality, type, type_confidence, dense, index_page, keyword_density, keyword_head_bonus). Texts of under
    50 characters are empty. dense and index_page are the signals of walls and of tables of contents. keyword may be a
    column; where it is null or empty there is none."""
    return scoring.score_of(col(text), scoring.keyword_column(keyword))


def detect_captcha(html: Column | str) -> Column:
    """struct(detected, type, site_key): the first family's first pattern that is found; its key if it has one."""
    h = col(html)
    tests = [(rx.found(h, p, icase=True), kind, F.regexp_extract(h, rx.java(p, icase=True), 1) if key else F.lit("")) for kind, patterns in rules.CAPTCHAS for p, key in patterns]
    kind = _first([(c, k) for c, k, _ in tests])
    key = F.when(tests[0][0], tests[0][2])
    for c, _, value in tests[1:]:
        key = key.when(c, value)
    return F.struct(kind.isNotNull().alias("detected"), F.coalesce(kind, F.lit("")).alias("type"), F.coalesce(key, F.lit("")).alias("site_key"))


def is_streaming_host(url: Column | str) -> Column:
    return F.coalesce(F.rlike(F.try_parse_url(url, F.lit("HOST")), F.lit(f"(?i){rules.STREAMING_HOSTS}")), F.lit(False))


def validate(text: Column | str, baseline: Column | str | None = None, keyword: Column | str | None = None, least: float = 0.5, front: float = 0.3, full: Column | None = None) -> Column:
    """struct(passes, passed, failed, checks, completeness, consistency): eight checks of an extracted text.

    failed counts all that fail; passed only those of completeness, keyword, density curve and consistency that hold.
    checks names the failed ones. A null text is checked as the empty one. full is the text's completeness if it is
    known already; keyword may be a column."""
    none = F.lit(None)
    return scoring.verdict_of(col(text), none.cast("string") if baseline is None else col(baseline), scoring.keyword_column(keyword), F.lit(float(least)), F.lit(float(front)), none.cast("double") if full is None else full)
