"""Text functions as Column expressions. Null in, null out, unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions import rules, rx, scoring


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scaled(score: Column) -> Column:
    """A score in ten-thousandths, rounded half up; engines agree on it where they differ on rounded doubles."""
    return F.floor(score * 10000 + 0.5 + 1e-9).cast("bigint")


def chars(text: Column) -> Column:
    """The code points as an array; the empty text gives none."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def holds(text: Column, words: list[str]) -> Column:
    """How many of the words occur, each once."""
    return reduce(add, [text.contains(w).cast("int") for w in words])


# pages


def html_to_text(html: Column | str) -> Column:
    """Text of a page: script-like elements vanish, tags become spaces, six entities are decoded in this order (so
    that &amp;lt; ends as <), runs of blanks and of line ends shrink, and the ends are trimmed."""
    out = F.regexp_replace(col(html), r"(?is)<(iframe|noscript|script|svg|style)[^>]*>.*?</\1>", "")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return rx.strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def capped_html(html: Column | str, most: int = 5 << 20, kept: int = 1 << 20) -> Column:
    """Pages of more than `most` characters are cut to `kept`."""
    return F.when(F.length(html) > most, F.substring(html, 1, kept)).otherwise(col(html))


def stage_error(status: Column | str, html: Column | str, text: Column | str) -> Column:
    """Why a plain fetch gives no text, or null if it does."""
    return (
        F.when(col(status) >= 400, F.concat(F.lit("HTTP "), col(status).cast("string")))
        .when(F.coalesce(F.length(html), F.lit(0)) == 0, "empty response")
        .when(F.length(text) > 100, F.lit(None).cast("string"))
        .otherwise("insufficient extracted content")
    )


def strip_reader_header(text: Column | str) -> Column:
    """A text that starts with Title: loses everything up to its first blank line; without one it stays. Trimmed."""
    t = col(text)
    line = f"[^\n]*{rx.NOT_WS}[^\n]*"
    head = rf"\A[^\n]*\n(?:{line}\n)*[^\S\n]*(?:\n|\z)".replace(r"[^\S\n]", rx.WS.replace(r"\t-\r", r"\t\x0b-\r"))
    return rx.strip(F.when(t.startswith("Title:"), F.regexp_replace(t, head, "")).otherwise(t))


# scores and flags


def completeness(text: Column | str) -> Column:
    """How complete an article a text looks, 0 to 0.93; texts of under 100 characters score 0. Null scores 0."""
    return scoring.completeness_of(col(text))


def is_complete(text: Column | str, least: float = 0.5) -> Column:
    return completeness(text) >= least


def density_curve(text: Column | str, parts: int = 5) -> Column:
    """Shares of visible characters in `parts` equal pieces (the remainder is left out); empty for the empty text."""
    t = col(text)
    size = F.greatest(F.floor(F.length(t) / parts), F.lit(1)).cast("int")
    piece = lambda i: F.substr(t, i * size + 1, size)
    curve = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.least(F.length(F.regexp_replace(piece(i), rx.WS, "")) / size, F.lit(1.0)))
    return F.when(F.length(t) > 0, curve).otherwise(F.array().cast("array<double>"))


def looks_garbled(text: Column | str) -> Column:
    """Over a tenth of the first 500 characters are replacement characters, NULs or beyond the basic plane."""
    sample = F.substring(text, 1, 500)
    return F.regexp_count(sample, F.lit(r"[\x{FFFD}\x{0000}\x{10000}-\x{10FFFF}]")) > F.length(sample) * 0.1


def has_private_use(text: Column | str) -> Column:
    """A private use character in the first 2000: a font that hides what it shows."""
    return F.rlike(F.substring(text, 1, 2000), F.lit(r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"))


def cjk_ratio(text: Column | str) -> Column:
    t = col(text)
    return F.when(F.length(t) == 0, 0.0).otherwise(F.regexp_count(t, F.lit(r"[\x{4E00}-\x{9FFF}]")) / F.length(t))


def boilerplate_hits(text: Column | str) -> Column:
    return holds(F.lower(text), rules.BOILERPLATE)


def looks_like_code(text: Column | str) -> Column:
    return reduce(or_, [col(text).contains(m) for m in rules.CODE_MARKS])


def consistency(one: Column | str, two: Column | str) -> Column:
    """Shared share of the smaller set of character trigrams (lowered, without white space, 4000 characters at most);
    1 if either has none."""
    return scoring.consistency_of(col(one), col(two))


def looks_like_index(text: Column | str) -> Column:
    """A table of contents: many chapter marks, or some in many short lines."""
    t = col(text)
    marks = rx.count(t, rf"第[{rules._N}\d]+[章节回卷部]")
    lines = F.filter(F.transform(F.split(t, "\n", -1), rx.strip), lambda x: F.length(x) > 0)
    total = F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x))
    listed = (F.size(lines) >= 15) & (total < 40 * F.size(lines)) & (marks >= 5)
    return (F.length(t) >= 200) & ((marks >= 20) | listed)


def is_chapter_link(label: Column | str) -> Column:
    return reduce(or_, [rx.found(col(label), p, icase) for p, icase in rules.CHAPTER_LINKS])


# rewriting


def cn_number(text: Column | str) -> Column:
    """A Chinese numeral as an integer: digits as they are, else units by accumulation up to the first other
    character; 1 if that gives nothing. White space around it doesn't count."""
    t = rx.strip(col(text))
    digit = F.create_map(*[x for c, v in rules.NUMERALS.items() for x in (F.lit(c), F.lit(v))])
    unit = F.create_map(*[x for c, v in rules.UNITS.items() for x in (F.lit(c), F.lit(v))])

    def step(s: Column, c: Column) -> Column:
        d, u = F.try_element_at(digit, c), F.try_element_at(unit, c)
        live = ~s["done"]
        total = F.when(live & u.isNotNull(), s["total"] + F.greatest(s["last"], F.when(s["last"] == 0, 1).otherwise(s["last"])) * u).otherwise(s["total"])
        last = F.when(live & d.isNotNull(), d).when(live & u.isNotNull(), 0).otherwise(s["last"])
        return F.struct(total.cast("int").alias("total"), last.cast("int").alias("last"), (s["done"] | (d.isNull() & u.isNull())).alias("done"))

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"), F.lit(False).alias("done"))
    value = F.aggregate(chars(t), start, step, lambda s: s["total"] + s["last"])
    plain = F.try_to_number(F.when(F.rlike(t, F.lit(r"^[0-9]{1,18}$")), t), F.lit("9" * 18)).cast("bigint")
    return F.coalesce(plain, F.when(value > 0, value).otherwise(1).cast("bigint"))


def chapter_url(base: Column | str, number: Column | str) -> Column:
    """The address of another chapter: a last number is replaced, else /number.html appended."""
    b, n = col(base), col(number).cast("string")
    stem, old, end = (F.regexp_extract(b, r"^(.+/)(\p{Nd}+)(\.html?)?$", k) for k in (1, 2, 3))
    return F.when(old != "", F.concat(stem, n, end)).otherwise(F.concat(F.rtrim(b, F.lit("/")), F.lit("/"), n, F.lit(".html")))


def clean_ocr(text: Column | str) -> Column:
    out = F.regexp_replace(col(text), " {3,}", "  ")
    out = F.regexp_replace(out, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    out = F.regexp_replace(out, "\r\n?", "\n")
    return rx.strip(rx.shorter_gaps(out))


def strip_page_tail(text: Column | str) -> Column:
    """Lines lose what follows a site's buttons."""
    return F.regexp_replace(col(text), f"({rules.TAIL_WORDS})[^\n]*", "")


def domain(url: Column | str) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), col(url))


def source_name(url: Column | str) -> Column:
    host = F.regexp_extract(url, r"https?://(?:www\.)?([^/]+)", 1)
    return F.when(host != "", host).otherwise(F.substring(url, 1, 40))


def profile_name(url: Column | str) -> Column:
    return F.regexp_replace(domain(url), r"[^\p{L}\p{N}._-]", "_")


def mask_proxy(proxy: Column | str) -> Column:
    return F.regexp_replace(col(proxy), "//[^/@]+@", "//***:***@")


def sort_key(label: Column | str) -> Column:
    digits = F.regexp_extract(label, r"(\p{Nd}+)", 1)
    return F.when(digits == "", col(label)).when(F.length(digits) >= 8, digits).otherwise(F.lpad(digits, 8, "0"))


def slug(label: Column | str, index: Column | str) -> Column:
    digits = F.regexp_extract(label, r"(\p{Nd}+)", 1)
    number = F.when(F.length(digits) >= 6, digits).otherwise(F.lpad(digits, 6, "0"))
    return F.when(digits != "", F.concat(F.lit("n"), number)).otherwise(F.format_string("i%06d", col(index)))


def guess_title(label: Column | str, url: Column | str) -> Column:
    title = rx.strip(rx.replace(label, r"第\s*\d+\s*章\s*", ""))
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(domain(url))


def fingerprint(text: Column | str) -> Column:
    return F.substring(F.regexp_replace(F.substring(text, 1, 300), rx.WS, ""), 1, 200)


def estimated_tokens(text: Column | str) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


#: Tried in this order after a hint.
ENCODINGS = ("utf-8", "gbk", "gb18030", "big5")


@cache
def _decoder():
    from itertools import starmap

    from pyspark.sql.types import StringType

    def one(body: bytes | None, hint: str | None) -> str | None:
        if body is None:
            return None
        for name in (hint, *ENCODINGS):
            try:
                if name:
                    return body.decode(name)
            except (UnicodeDecodeError, LookupError):
                pass
        return body.decode("utf-8", errors="replace")

    # the legacy encodings, and failing on bytes that aren't theirs, are Python's
    return F.arrow_udf(lambda body, hint: scoring.strings(starmap(one, scoring.each(body, hint))), StringType())


def decoded(body: Column | str, hint: Column | str | None = None) -> Column:
    """Bytes as text by the first encoding that fits: the hint (a column), then ENCODINGS; else UTF-8 with replacement
    characters. Unknown hints are passed over."""
    return _decoder()(col(body), F.lit(None).cast("string") if hint is None else col(hint))


def api_text(url: Column | str, content_type: Column | str, body: Column | str) -> Column:
    """What a response to a page's own request gives: of JSON its longest text, of HTML from an address with /api/ the
    decoded body if it has over 200 characters; else null. body is binary."""
    from corpusflow.functions import json_dig

    kind = F.lower(content_type)
    html = decoded(F.when(kind.contains("html") & col(url).contains("/api/"), col(body)))
    found = json_dig.longest_text(F.when(kind.contains("json"), F.decode(col(body), "UTF-8")))
    return F.when(F.length(html) > 200, html).otherwise(found)


def captured_body(content_type: Column | str, body: Column | str) -> Column:
    """What a browser keeps of a response: the first 5,000 characters of JSON of over 200, or 10,000 of HTML of over
    500; else null."""
    kind, n = F.lower(content_type), F.length(body)
    return F.when(kind.contains("json"), F.when(n > 200, F.substring(body, 1, 5000))).when(kind.contains("html") & (n > 500), F.substring(body, 1, 10000))


def browser_text(parts: Column, bodies: Column) -> Column:
    """A page's collected parts, blank lines between, then the kept bodies with rules between, stripped."""
    page = F.array_join(parts, "\n\n")
    return rx.strip(F.when(F.size(bodies) > 0, F.concat(page, F.lit("\n\n"), F.array_join(bodies, "\n---\n"))).otherwise(page))


def fast_text(reader: Column | str, browser: Column | str) -> Column:
    """A quick look at a page: what a reader service gives if that is over 200 visible characters, 5,000 at most; else
    what a browser gives."""
    return F.when(F.length(rx.strip(col(reader))) > 200, F.substring(reader, 1, 5000)).otherwise(col(browser))


def error_text(message: Column | str, most: int = 200) -> Column:
    return F.substring(message, 1, most)
