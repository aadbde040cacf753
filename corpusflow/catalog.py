"""Every operator as a query on the test tables, with SQL for another engine where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.functions import classify as C
from corpusflow.functions import json_dig, rules, rx
from corpusflow.functions import text as T
from corpusflow.operators import align, dedup, frames, jobs, links, schedule, select, serp
from corpusflow.plans import fixtures, pipeline
from corpusflow.sources import batch
from corpusflow.streaming import limiter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# SQL's side


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list_of(values: list[str]) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _p(pattern: str, icase: bool = False, lines: bool = False) -> str:
    flags = ("i" if icase else "") + ("m" if lines else "")
    return _q((f"(?{flags})" if flags else "") + rx.wide(pattern))


def _has(s: str, pattern: str, icase: bool = False, lines: bool = False) -> str:
    return f"regexp_matches({s}, {_p(pattern, icase, lines)})"


def _count(s: str, pattern: str) -> str:
    return f"len(regexp_extract_all({s}, {_p(pattern)}))"


def _sub(s: str, pattern: str, by: str) -> str:
    return f"regexp_replace({s}, {_p(pattern)}, {_q(by)}, 'g')"


def _strip(s: str) -> str:
    return _sub(s, rf"^\s+|\s+\z", "")


def _int(s: str) -> str:
    return f"CAST(floor(({s}) * 1e4 + 5e-1 + 1e-9) AS BIGINT)"


def _words(s: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({s}, {_q(w)}) AS INTEGER)" for w in words) + ")"


def _with(*names: str) -> str:
    need = {"stages": ["docs"]}
    order = [n for name in names for n in (*need.get(name, []), name)]
    return ", ".join(f"{n} AS ({fixtures.SQL[n]})" for n in dict.fromkeys(order))


def _completeness(t: str) -> str:
    """For a stripped, never null t."""
    lines = f"list_filter(string_split({t}, chr(10)), lambda x: {_has('x', chr(92) + 'S')})"
    top = f"substr({t}, 1, 800)"
    rows = f"greatest(len({lines}), 1)"
    skeleton = f"({_words(top, rules.SKELETON)} + CAST({_has(top, 'loading', icase=True)} AS INTEGER))"
    score = f"""least(length({t}) / 5e3, 1e0) * 3e-1 + least({_count(t, chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')} / 15e0, 1e0) * 2e-1
        + least({_count(t, '[。！？.!?' + chr(92) + 'n]')} / CAST({rows} AS DOUBLE), 1e0) * 15e-2
        + least(len(list_filter({lines}, lambda x: length(x) > 80)) / CAST({rows} AS DOUBLE) * 2, 1e0) * 1e-1
        - least({_words(f'lower({top})', rules.BOILERPLATE)} * 4e-2 + {skeleton} * 6e-2, 25e-2)
        + least(len(list_distinct(string_split({t}, ''))) / CAST(greatest(length({t}), 1) AS DOUBLE) * 5, 1e0) * 1e-1
        + CASE WHEN {_has(t, '[│┌├└─|]')} THEN 5e-2 ELSE 0e0 END + CASE WHEN {_has(t, '^' + chr(92) + 's*[-*]' + chr(92) + 's', lines=True)} THEN 3e-2 ELSE 0e0 END"""
    return f"CASE WHEN length({t}) < 100 THEN 0e0 ELSE greatest(least({score}, 1e0), 0e0) END"


def _curve(t: str) -> str:
    size = f"greatest(length({t}) // 5, 1)"
    return f"CASE WHEN length({t}) > 0 THEN list_transform(range(5), lambda i: least(length({_sub(f'substr({t}, i * {size} + 1, {size})', chr(92) + 's', '')}) / CAST({size} AS DOUBLE), 1e0)) ELSE [] END"


_HTML = "html"
for _tag in ("script", "style", "noscript", "iframe", "svg"):
    _HTML = f"regexp_replace({_HTML}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', '', 'g')"
_HTML = f"regexp_replace({_HTML}, '<[^>]+>', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
    _HTML = f"replace({_HTML}, {_q(_e)}, {_q(_c)})"
_HTML = _strip(f"regexp_replace(regexp_replace({_HTML}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


@query("html_to_text", f"WITH {_with('html')} SELECT page_id, {_HTML} AS text FROM html")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.pages(spark, d).select("page_id", T.html_to_text("html").alias("text"))


@query("stage_accept", f"""WITH {_with('html')}, t AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END AS status, html, {_HTML} AS text FROM html)
    SELECT page_id, CASE WHEN status >= 400 THEN 'HTTP ' || status WHEN length(html) = 0 THEN 'empty response' WHEN length(text) > 100 THEN NULL ELSE 'insufficient extracted content' END AS error,
    status BETWEEN 200 AND 399 AS ok, CAST(length(text) // 4 AS INTEGER) AS tokens FROM t""")
def stage_accept(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.pages(spark, d).withColumn("status", F.when(F.col("page_id") % 7 == 0, 404).otherwise(200)).withColumn("text", T.html_to_text(T.capped_html("html")))
    return rows.select("page_id", T.stage_error("status", "html", "text").alias("error"), F.col("status").between(200, 399).alias("ok"), T.estimated_tokens("text").alias("tokens"))


@query("completeness", f"WITH {_with('docs')}, t AS (SELECT doc_id, {_strip('text')} AS t FROM docs), s AS (SELECT doc_id, {_completeness('t')} AS s FROM t) SELECT doc_id, {_int('s')} AS score, s >= 5e-1 AS complete FROM s")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    score = T.completeness("text")
    return fixtures.documents(spark, d).select("doc_id", score.alias("s")).select("doc_id", T.scaled(F.col("s")).alias("score"), (F.col("s") >= 0.5).alias("complete"))


@query("density_curve", f"WITH {_with('docs')} SELECT doc_id, array_to_string(list_transform({_curve('text')}, lambda x: {_int('x')}), ',') AS curve FROM docs")
def density_curve(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.documents(spark, d).select("doc_id", F.array_join(F.transform(T.density_curve("text"), T.scaled), ",").alias("curve"))


_PUA = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"


@query("text_flags", f"""WITH {_with('docs')} SELECT doc_id, {_has('substr(text, 1, 2000)', _PUA)} AS private_use,
    {_int(f"{_count('text', '[' + chr(92) + 'x{4E00}-' + chr(92) + 'x{9FFF}]')} / CAST(length(text) AS DOUBLE)")} AS cjk, {_words('lower(text)', rules.BOILERPLATE)} AS boilerplate,
    {_count('substr(text, 1, 500)', '[' + chr(92) + 'x{FFFD}' + chr(92) + 'x{10000}-' + chr(92) + 'x{10FFFF}]')} > length(substr(text, 1, 500)) * 1e-1 AS garbled,
    {' OR '.join(f"contains(text, {_q(m)})" for m in rules.CODE_MARKS)} AS code FROM docs""")
def text_flags(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.documents(spark, d).select("doc_id", T.has_private_use("text").alias("private_use"), T.scaled(T.cjk_ratio("text")).alias("cjk"), T.boilerplate_hits("text").alias("boilerplate"), T.looks_garbled("text").alias("garbled"), T.looks_like_code("text").alias("code"))


def _normal(s: str) -> str:
    return f"substr({_sub(f'lower({s})', chr(92) + 's', '')}, 1, 4000)"


def _grams(t: str) -> str:
    """Of a column made by _normal."""
    return f"list_distinct(list_transform(range(1, greatest(length({t}) - 1, 1)), lambda i: substr({t}, i, 3)))"


@query("text_consistency", f"""WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM conversations),
    m AS MATERIALIZED (SELECT conv_id, turn, {_normal('text')} AS x, {_normal('other')} AS y FROM p WHERE other IS NOT NULL), g AS (SELECT conv_id, turn, {_grams('x')} AS a, {_grams('y')} AS b FROM m)
    SELECT conv_id, turn, CASE WHEN least(len(a), len(b)) = 0 THEN 10000 ELSE {_int('len(list_intersect(a, b)) / CAST(least(len(a), len(b)) AS DOUBLE)')} END AS same FROM g""")
def text_consistency(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet").withColumn("other", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("other is not null")
    return rows.select("conv_id", "turn", T.scaled(T.consistency("text", "other")).alias("same"))


#: doc_id in Chinese numerals as far as its thousands, by doc_id % 6 with blanks, a stray character, as digits, or bare
_DIGITS = ["", *"一二三四五六七八九"]
_PLACES = [(1000, "千"), (100, "百"), (10, "十"), (1, "")]


def _numeral(i: Column) -> Column:
    digit = lambda k: (F.floor(i / k) % 10).cast("int")
    spelled = F.concat(*[F.when(digit(k) > 0, F.concat(F.element_at(F.array(*[F.lit(d) for d in _DIGITS]), digit(k) + 1), F.lit(unit))).otherwise("") for k, unit in _PLACES])
    kinds = [spelled, F.concat(F.lit(" "), spelled, F.lit("　")), F.concat(spelled, F.lit("x九")), F.concat(F.lit(" "), i.cast("string"), F.lit("\n")), F.concat(F.lit("零"), spelled), F.concat(F.lit("十"), spelled)]
    return F.element_at(F.array(*kinds), (i % 6).cast("int") + 1)


_SPELLED = " || ".join(f"CASE WHEN i // {k} % 10 > 0 THEN ({_list_of(_DIGITS)})[i // {k} % 10 + 1] || '{unit}' ELSE '' END" for k, unit in _PLACES)
_NUMERAL = f"""n AS (SELECT i, ([p, ' ' || p || '　', p || 'x九', ' ' || i || chr(10), '零' || p, '十' || p])[i % 6 + 1] AS numeral FROM (SELECT doc_id AS i, {_SPELLED} AS p FROM (SELECT doc_id, CAST(doc_id AS INTEGER) AS i FROM documents)))"""


def _number(t: str) -> str:
    """The value of a numeral, character by character: total, what stands before the next unit, and whether it goes on."""
    of = lambda m: "CASE x.c " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in m.items()) + " END"
    digit, unit = of(rules.NUMERALS), of(rules.UNITS)
    zero = "{'c': '', 'total': 0, 'last': 0, 'on': true}"
    step = f"""{{'c': '', 'total': CASE WHEN s.on AND {unit} IS NOT NULL THEN s.total + greatest(s.last, 1) * {unit} ELSE s.total END,
        'last': CASE WHEN s.on THEN coalesce({digit}, CASE WHEN {unit} IS NOT NULL THEN 0 END, s.last) ELSE s.last END, 'on': s.on AND coalesce({digit}, {unit}) IS NOT NULL}}"""
    chars = f"list_transform(string_split({t}, ''), lambda c: {{'c': c, 'total': 0, 'last': 0, 'on': true}})"
    end = f"list_reduce(list_prepend({zero}, {chars}), lambda s, x: {step})"
    return f"CASE WHEN regexp_matches({t}, '^[0-9]{{1,18}}$') THEN CAST({t} AS BIGINT) ELSE CAST(greatest(({end}).total + ({end}).last, 1) AS BIGINT) END"


@query("cn_numeral", f"WITH {_NUMERAL}, t AS (SELECT i, numeral, {_strip('numeral')} AS t FROM n) SELECT i AS doc_id, numeral, CASE WHEN regexp_matches(t, '^[0-9]+$') THEN TRY_CAST(t AS BIGINT) ELSE {_number('t')} END AS value FROM t")
def cn_numeral(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", _numeral(F.col("doc_id")).alias("numeral"))
    return rows.withColumn("value", T.cn_number("numeral"))


@query("chapter_url_guess", f"""WITH {_with('urls')} SELECT id, CASE WHEN regexp_matches(url, '^(.+/)(\\p{{Nd}}+)(\\.html?)?$') THEN regexp_replace(url, '^(.+/)(\\p{{Nd}}+)(\\.html?)?$', '\\1' || id || '\\3')
    ELSE rtrim(url, '/') || '/' || id || '.html' END AS guess FROM urls""")
def chapter_url_guess(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.urls(spark, d).select("id", T.chapter_url("url", "id").alias("guess"))


@query("text_cleaning", f"""WITH {_with('docs')}, o AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(text, ' {{3,}}', '  ', 'g'), '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '\\r\\n?', chr(10), 'g') AS o FROM docs)
    SELECT doc_id, {_strip("regexp_replace(o, '" + chr(92) + "n{4,}', chr(10) || chr(10) || chr(10), 'g')")} AS ocr,
    {_strip("CASE WHEN NOT starts_with(text, 'Title:') THEN text WHEN contains(text, chr(10) || chr(10)) THEN substr(text, strpos(text, chr(10) || chr(10)) + 2) ELSE text END")} AS body,
    regexp_replace(text, '({rules.TAIL_WORDS})[^\\n]*', '', 'g') AS tail, substr({_sub('substr(text, 1, 300)', chr(92) + 's', '')}, 1, 200) AS print FROM o""")
def text_cleaning(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.documents(spark, d).select("doc_id", T.clean_ocr("text").alias("ocr"), T.strip_reader_header("text").alias("body"), T.strip_page_tail("text").alias("tail"), T.fingerprint("text").alias("print"))


def _url_type(u: str) -> str:
    has = lambda words: "(" + " OR ".join(f"contains({u}, {_q(w)})" for w in words) + ")"
    (_, novel), *others = rules.ADDRESSES
    kinds = " ".join(f"WHEN {has(w)} THEN '{k}'" for k, w in others)
    return f"CASE WHEN {has(novel)} THEN CASE WHEN {_has(u, '/' + chr(92) + 'd+(_?' + chr(92) + 'd+)?' + chr(92) + '.html?')} THEN 'novel_chapter' WHEN {_has(u, '/(index|list|catalog|menu|dir)')} THEN 'novel_index' ELSE 'novel_chapter' END {kinds} ELSE 'unknown' END"


_STRONG = "CASE " + " ".join(f"WHEN {_has('url', p, icase=True)} THEN {_q('matched:' + p)}" for p in rules.NOISE_HIGH) + " END"
_WEAK = "(" + " + ".join(f"CAST({_has('url', p, icase=True)} AS INTEGER)" for p in rules.NOISE_MID) + ")"
_VERDICT = f"""SELECT *, CASE WHEN strong IS NOT NULL THEN 'noise_high' WHEN weak >= 3 THEN 'noise_mid_multi' WHEN weak >= 1 THEN 'uncertain' ELSE {_url_type('lower(url)')} END AS type,
    strong IS NULL AND weak < 3 AS is_content FROM (SELECT *, {_STRONG} AS strong, {_WEAK} AS weak FROM @from@)"""


@query("url_classify", f"""WITH {_with('urls')}, v AS ({_VERDICT.replace('@from@', 'urls')})
    SELECT id, is_content, type, CASE WHEN strong IS NOT NULL THEN 9500 WHEN weak >= 3 THEN 7000 WHEN weak >= 1 THEN 4000 ELSE 6500 END AS confidence,
    coalesce(strong, CASE WHEN weak >= 1 THEN 'mid hits: ' || weak ELSE 'clean URL' END) AS reason, NOT ({' OR '.join(_has('url', p, icase=True) for p in rules.UNLIKELY)}) AS likely, {_url_type('lower(url)')} AS inferred FROM v""")
def url_classify(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.urls(spark, d).withColumn("v", C.classify_url("url"))
    return rows.select("id", "v.is_content", "v.type", T.scaled(F.col("v.confidence")).alias("confidence"), "v.reason", C.is_likely_content("url").alias("likely"), C.url_type("url").alias("inferred"))


def _scores(t: str) -> list[str]:
    out = []
    for s in rules.SIGNATURES:
        must = " OR ".join(_has(t, p) for p, _ in s.must)
        total = " + ".join(f"CAST({_has(t, p)} AS INTEGER) * ({w})" for p, w in [*s.must, *s.others])
        out.append(f"CASE WHEN length({t}) >= {s.least} AND ({must}) THEN {total} ELSE 0 END")
    return out


def _typed(source: str, t: str = "t") -> str:
    """source with kind and best."""
    inner = f"SELECT *, [{', '.join(_scores(t))}] AS sc FROM {source}"
    names = "[" + ", ".join(_q(s.kind) for s in rules.SIGNATURES) + "]"
    return f"SELECT *, greatest(list_max(sc), 0) AS best, CASE WHEN list_max(sc) > 0 THEN ({names})[list_position(sc, list_max(sc))] ELSE 'unknown' END AS kind FROM ({inner})"


@query("content_type", f"WITH {_with('docs')}, k AS ({_typed('docs', 'text')}) SELECT doc_id, kind AS type, CAST(best AS INTEGER) AS score FROM k")
def content_type(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.documents(spark, d).select("doc_id", C.content_type("text").alias("c")).select("doc_id", "c.type", "c.score")


def _quality(extra: str = "") -> str:
    """Of rows with t (stripped) and kind."""
    walls = _words("lower(substr(t, 1, 500))", rules.BOILERPLATE)
    paragraphs, sentences = _count("t", r"\n\s*\n"), _count("t", "[。！？.!?\n]".replace("\n", r"\n"))
    q = f"""(CASE WHEN length(t) >= 2000 THEN 35e-2 WHEN length(t) >= 1000 THEN 25e-2 WHEN length(t) >= 500 THEN 15e-2 WHEN length(t) >= 200 THEN 8e-2 ELSE 0e0 END
        + CASE WHEN {paragraphs} >= 10 THEN 2e-1 WHEN {paragraphs} >= 5 THEN 12e-2 WHEN {paragraphs} >= 2 THEN 6e-2 ELSE 0e0 END
        + CASE WHEN {sentences} >= 20 THEN 15e-2 WHEN {sentences} >= 5 THEN 8e-2 ELSE 0e0 END
        + CASE WHEN {walls} >= 3 THEN -25e-2 WHEN {walls} >= 1 THEN -1e-1 ELSE 0e0 END
        + CASE WHEN kind = 'novel_index' THEN -15e-2 ELSE 0e0 END{extra})"""
    return f"CASE WHEN length(t) >= 50 THEN greatest(least({q}, 1e0), 0e0) ELSE 0e0 END"


@query("content_score", f"""WITH {_with('docs')}, s AS (SELECT doc_id, {_strip('text')} AS t FROM docs), k AS ({_typed('s')})
    SELECT doc_id, {_int(_quality())} AS quality, CASE WHEN length(t) >= 50 THEN kind ELSE 'empty' END AS type,
    CASE WHEN length(t) >= 50 THEN {_int('least(best / 4e1, 1e0)')} ELSE 0 END AS confidence, length(t) >= 50 AND {_words('lower(substr(t, 1, 500))', rules.BOILERPLATE)} >= 3 AS dense FROM k""")
def content_score(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.documents(spark, d).select("doc_id", C.score_content("text").alias("s"))
    return rows.select("doc_id", T.scaled(F.col("s.quality")).alias("quality"), "s.type", T.scaled(F.col("s.type_confidence")).alias("confidence"), "s.dense")


_HITS = "(len(string_split(lower({0}), '三体')) - 1)"


@query("content_score_kw", f"""WITH {_with('docs')}, s AS (SELECT doc_id, {_strip('text')} AS t FROM docs), k AS ({_typed('s')}),
    m AS (SELECT *, {_HITS.format('t')} / (length(t) / 1e2) AS density, strpos(lower(t), '三体') > 0 AND strpos(lower(t), '三体') - 1 < length(t) * 2e-1 AS head FROM k)
    SELECT doc_id, {_int(_quality(' + CASE WHEN head THEN 1e-1 ELSE 0e0 END + least(density * 8, 15e-2)'))} AS quality, CASE WHEN length(t) >= 50 THEN {_int('density')} ELSE 0 END AS density, length(t) >= 50 AND head AS head FROM m""")
def content_score_kw(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.documents(spark, d).select("doc_id", C.score_content("text", "三体").alias("s"))
    return rows.select("doc_id", T.scaled(F.col("s.quality")).alias("quality"), T.scaled(F.col("s.keyword_density")).alias("density"), F.col("s.keyword_head_bonus").alias("head"))


_RUNS = "list_filter(regexp_extract_all(lower(text), '[a-zA-Z]+'), lambda x: x = 'the')"


@query("keyword_match", f"""WITH {_with('docs')}, h AS (SELECT doc_id, text, len({_RUNS}) + {_HITS.format('text')} AS hits FROM docs)
    SELECT doc_id, CAST(hits AS INTEGER) AS hits, {_int('hits / (length(text) / 1e2)')} AS density, array_to_string(list_filter([CASE WHEN len({_RUNS}) > 0 THEN 'The' END, CASE WHEN contains(text, '三体') THEN '三体' END], lambda x: x IS NOT NULL), ',') AS matches FROM h""")
def keyword_match(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.documents(spark, d).select("doc_id", C.match_keywords("text", "The 三体 x").alias("m"))
    return rows.select("doc_id", "m.hits", T.scaled(F.col("m.density")).alias("density"), F.array_join("m.matches", ",").alias("matches"))


_KEYS = ["三体", "login", "", "章", "paragraph", "中文", "loading"]
_KEY_HITS = "CASE WHEN length(keyword) < 2 THEN 0 WHEN regexp_matches(keyword, '^[a-z]+$') THEN len(list_filter(regexp_extract_all(lower(t), '[a-zA-Z]+'), lambda x: x = keyword)) ELSE len(string_split(lower(t), keyword)) - 1 END"
_KEY_AT = "CASE WHEN length(keyword) < 2 THEN 0 WHEN regexp_matches(keyword, '^[a-z]+$') THEN length(regexp_extract(lower(t), '(?s)^(.*?(?:^|[^a-zA-Z]))' || keyword || '(?:[^a-zA-Z]|$)', 1)) + CASE WHEN hits > 0 THEN 1 ELSE 0 END ELSE strpos(lower(t), keyword) END"
_KEYED = f"""m AS (SELECT *, {_KEY_HITS} AS hits FROM k), a AS (SELECT *, {_KEY_AT} AS spot FROM m),
    h AS (SELECT *, hits / (length(t) / 1e2) AS density, hits > 0 AND spot - 1 < length(t) * 2e-1 AS head FROM a)"""
_KEY_GAIN = " + CASE WHEN head THEN 1e-1 ELSE 0e0 END + least(density * 8, 15e-2)"


def _key(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in _KEYS]), (number % len(_KEYS)).cast("int") + 1)


@query("content_score_keys", f"""WITH {_with('docs')}, s AS (SELECT doc_id, ({_list_of(_KEYS)})[CAST(doc_id % {len(_KEYS)} AS INTEGER) + 1] AS keyword, {_strip('text')} AS t FROM docs), k AS ({_typed('s')}), {_KEYED}
    SELECT doc_id, keyword, {_int(_quality(_KEY_GAIN))} AS quality, CASE WHEN length(t) >= 50 THEN {_int('density')} ELSE 0 END AS density, length(t) >= 50 AND head AS head FROM h""")
def content_score_keys(spark: SparkSession, d: str) -> DataFrame:
    """Every row has a keyword of its own."""
    rows = fixtures.documents(spark, d).withColumn("keyword", _key(F.col("doc_id")))
    rows = rows.select("doc_id", "keyword", C.score_content("text", F.col("keyword")).alias("s"))
    return rows.select("doc_id", "keyword", T.scaled(F.col("s.quality")).alias("quality"), T.scaled(F.col("s.keyword_density")).alias("density"), F.col("s.keyword_head_bonus").alias("head"))


def _captcha() -> tuple[str, str]:
    kind = key = "CASE"
    for k, patterns in rules.CAPTCHAS:
        for p, grouped in patterns:
            kind += f" WHEN {_has('html', p, icase=True)} THEN '{k}'"
            key += f" WHEN {_has('html', p, icase=True)} THEN " + (f"regexp_extract(html, {_p(p, icase=True)}, 1)" if grouped else "''")
    return kind + " ELSE '' END", key + " ELSE '' END"


@query("captcha_detect", f"WITH {_with('html')}, k AS (SELECT page_id, {_captcha()[0]} AS type, {_captcha()[1]} AS site_key FROM html) SELECT page_id, type <> '' AS detected, type, site_key FROM k")
def captcha_detect(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.pages(spark, d).select("page_id", C.detect_captcha("html").alias("c")).select("page_id", "c.detected", "c.type", "c.site_key")


_MARKS = _count("text", r"第[一二三四五六七八九十百千\d]+[章节回卷部]")
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: length(x) > 0)"


@query("index_page", f"""WITH {_with('docs')} SELECT doc_id, length(text) >= 200 AND ({_MARKS} >= 20 OR (len({_LINES}) >= 15 AND list_sum(list_transform({_LINES}, lambda x: length(x))) < 40 * len({_LINES}) AND {_MARKS} >= 5)) AS listed,
    {' OR '.join(_has('substr(text, 1, 12)', p, icase=i) for p, i in rules.CHAPTER_LINKS)} AS chapter FROM docs""")
def index_page(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.documents(spark, d).select("doc_id", T.looks_like_index("text").alias("listed"), T.is_chapter_link(F.substring("text", 1, 12)).alias("chapter"))


def _agrees(x: str, y: str) -> str:
    """Whether two texts of which _normal() is x and y share enough."""
    a, b = _grams(x), _grams(y)
    return f"(least(len({a}), len({b})) = 0 OR len(list_intersect({a}, {b})) / CAST(least(len({a}), len({b})) AS DOUBLE) >= 5e-2)"


def _valid(t: str, least: str = "5e-1") -> str:
    """Whether text t, never null, passes without a keyword or baseline."""
    s, c = _strip(t), _curve(t)
    front = f"(len({c}) >= 5 AND ({c})[1] > 0 AND ({c})[5] / ({c})[1] < 3e-1)"
    return f"(({_completeness(s)}) >= {least} AND NOT {front} AND NOT {_has(f'substr({t}, 1, 2000)', _PUA)} AND {_words(f'lower(substr({t}, 1, 500))', rules.BOILERPLATE)} < 3 AND length({_sub(t, chr(92) + 's', '')}) >= 100)"


_PAIR = f"d AS (SELECT doc_id, text, substr(text, 100) AS base FROM docs)"


@query("validate_gate", f"""WITH {_with('docs')}, {_PAIR}, c AS (SELECT *, {_completeness(_strip('text'))} AS full_, {_curve('text')} AS curve FROM d),
    m AS MATERIALIZED (SELECT *, {_normal('text')} AS x, {_normal('base')} AS y FROM c), g AS (SELECT *, {_grams('x')} AS a, {_grams('y')} AS b FROM m),
    e AS (SELECT doc_id, full_, curve, CASE WHEN length(text) >= 200 AND length(base) >= 200 THEN CASE WHEN least(len(a), len(b)) = 0 THEN 1e0 ELSE len(list_intersect(a, b)) / CAST(least(len(a), len(b)) AS DOUBLE) END END AS same,
        [CASE WHEN full_ < 3e-1 THEN 'completeness' END, CASE WHEN NOT contains(lower(text), '三体') THEN 'keyword' END,
         CASE WHEN len(curve) >= 5 AND curve[1] > 0 AND curve[5] / curve[1] < 3e-1 THEN 'front_heavy' END, CASE WHEN {_has('substr(text, 1, 2000)', _PUA)} THEN 'font_encryption' END,
         CASE WHEN {_words('lower(substr(text, 1, 500))', rules.BOILERPLATE)} >= 3 THEN 'boilerplate' END,
         CASE WHEN {_count('substr(text, 1, 2000)', '[' + chr(92) + 'x{4E00}-' + chr(92) + 'x{9FFF}]')} / CAST(length(substr(text, 1, 2000)) AS DOUBLE) < 5e-2 AND length(text) > 500 THEN 'language' END,
         CASE WHEN length({_sub('text', chr(92) + 's', '')}) < 100 THEN 'too_short' END] AS f FROM g),
    r AS (SELECT doc_id, full_, same, curve, list_filter(list_append(f, CASE WHEN same < 5e-2 THEN 'inconsistent' END), lambda x: x IS NOT NULL) AS f FROM e)
    SELECT doc_id, len(f) = 0 AS passes, CAST(len(f) AS INTEGER) AS failed,
        CAST(NOT list_contains(f, 'completeness') AS INTEGER) + CAST(NOT list_contains(f, 'keyword') AS INTEGER) + CAST(len(curve) > 0 AND NOT list_contains(f, 'front_heavy') AS INTEGER) + CAST(coalesce(same >= 5e-2, false) AS INTEGER) AS passed,
        array_to_string(f, ',') AS checks, {_int('full_')} AS completeness, {_int('same')} AS consistency FROM r""")
def validate_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.documents(spark, d).select("doc_id", "text", F.substr("text", F.lit(100)).alias("base"))
    rows = rows.select("doc_id", C.validate(F.col("text"), F.col("base"), "三体", 0.3).alias("v"))
    return rows.select("doc_id", "v.passes", "v.failed", "v.passed", F.array_join("v.checks", ",").alias("checks"), T.scaled(F.col("v.completeness")).alias("completeness"), T.scaled(F.col("v.consistency")).alias("consistency"))


_MERGED = f"""{_with('serp')}, per AS (SELECT query_id, url, backend_pos, backend, count(*) AS n, max(rank) AS rank FROM serp WHERE url IS NOT NULL GROUP BY ALL),
    merged AS (SELECT query_id, url, CAST(sum(n) AS BIGINT) AS cross_hits, CAST(sum(rank) AS BIGINT) / CAST(count(*) AS DOUBLE) AS avg_rank, string_agg(repeat(backend || ',', n), '' ORDER BY backend_pos, backend) AS backends FROM per GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cross_hits DESC, avg_rank, url DESC) AS rank FROM merged QUALIFY rank <= 20)"""


@query("serp_merge", f"WITH {_MERGED} SELECT query_id, url, cross_hits, {_int('avg_rank')} AS avg_rank, rtrim(backends, ',') AS backends FROM merged")
def serp_merge(spark: SparkSession, d: str) -> DataFrame:
    return serp.merge(fixtures.serp(spark, d)).select("query_id", "url", "cross_hits", T.scaled(F.col("avg_rank")).alias("avg_rank"), F.array_join("backends", ",").alias("backends"))


@query("serp_topk", f"WITH {_MERGED} SELECT query_id, CAST(rank AS INTEGER) AS rank, url, cross_hits FROM top")
def serp_topk(spark: SparkSession, d: str) -> DataFrame:
    return serp.top(serp.merge(fixtures.serp(spark, d))).select("query_id", "rank", "url", "cross_hits")


@query("serp_stats", f"""WITH {_with('serp')}, t AS (SELECT query_id, count(*) AS total_raw, count(DISTINCT url) AS total_unique FROM serp GROUP BY 1)
    SELECT query_id, backend, count(*) AS hits, any_value(total_raw) AS total_raw, any_value(total_unique) AS total_unique FROM serp JOIN t USING (query_id) GROUP BY 1, 2""")
def serp_stats(spark: SparkSession, d: str) -> DataFrame:
    return serp.stats(fixtures.serp(spark, d)).select("query_id", "backend", "hits", "total_raw", "total_unique")


@query("search_filter", f"WITH {_MERGED}, v AS ({_VERDICT.replace('@from@', 'top')}) SELECT query_id, CAST(rank AS INTEGER) AS rank, url, type FROM v WHERE is_content OR type = 'novel_index'")
def search_filter(spark: SparkSession, d: str) -> DataFrame:
    return serp.worth_reading(serp.top(serp.merge(fixtures.serp(spark, d)))).select("query_id", "rank", "url", "verdict.type")


@query("search_report", f"WITH {_MERGED} SELECT query_id, '# Search results' || chr(10) || chr(10) || string_agg(rank || '. [' || url || '](' || url || ') — ' || replace(rtrim(backends, ','), ',', ', '), chr(10) ORDER BY rank) AS report, string_agg(url, chr(10) ORDER BY rank) AS plain FROM top GROUP BY 1")
def search_report(spark: SparkSession, d: str) -> DataFrame:
    top = serp.top(serp.merge(fixtures.serp(spark, d)))
    return batch.search_report(top).join(batch.search_report(top, "text").withColumnRenamed("report", "plain"), "query_id")


def _verify_sql(required: bool) -> str:
    density = f"{_HITS.format('t')} / (length(t) / 1e2)"
    head = "(strpos(lower(t), '三体') > 0 AND strpos(lower(t), '三体') - 1 < length(t) * 2e-1)"
    return f"""WITH {_with('docs')}, s AS (SELECT doc_id % 50 AS query_id, doc_id AS pos, {_strip('text')} AS t, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS n FROM docs QUALIFY n <= 10),
        k AS ({_typed('s')}), q AS (SELECT *, {_quality(f" + CASE WHEN {head} THEN 1e-1 ELSE 0e0 END + least({density} * 8, 15e-2)")} - CASE WHEN kind = 'novel_index' AND length(t) >= 50 THEN 3e-1 ELSE 0e0 END AS quality, {head} AND length(t) >= 50 AS head FROM k WHERE length(t) >= 50{f" AND {density} > 0" if required else ""}),
        f AS (SELECT *, coalesce(sum(CAST(quality >= 7e-1 AND head AS INTEGER)) OVER (PARTITION BY query_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM q WHERE quality > 0)
        SELECT query_id, pos, {_int('quality')} AS quality, kind AS type, CAST(row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, n) AS INTEGER) AS rank FROM f WHERE stopped = 0"""


def _verified(spark: SparkSession, d: str, required: bool) -> DataFrame:
    rows = fixtures.documents(spark, d).select((F.col("doc_id") % 50).alias("query_id"), F.col("doc_id").alias("pos"), F.lit("u").alias("url"), F.col("text").alias("preview"))
    return select.verify(rows, "三体", keyword_required=required).select("query_id", "pos", T.scaled(F.col("quality")).alias("quality"), "type", "rank")


QUERIES["verify_rank"], SQL["verify_rank"] = lambda s, d: _verified(s, d, False), _verify_sql(False)
QUERIES["quick_scan_rank"], SQL["quick_scan_rank"] = lambda s, d: _verified(s, d, True), _verify_sql(True)

@query("verify_keys", f"""WITH {_with('docs')}, s AS (SELECT doc_id % 50 AS query_id, ({_list_of(_KEYS)})[CAST(doc_id % 50 % {len(_KEYS)} AS INTEGER) + 1] AS keyword, doc_id AS pos, {_strip('text')} AS t, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS n FROM docs QUALIFY n <= 10),
    k AS ({_typed('s')}), {_KEYED}, q AS (SELECT *, {_quality(_KEY_GAIN)} - CASE WHEN kind = 'novel_index' THEN 3e-1 ELSE 0e0 END AS quality FROM h WHERE length(t) >= 50),
    f AS (SELECT *, coalesce(sum(CAST(quality >= 7e-1 AND head AS INTEGER)) OVER (PARTITION BY query_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM q WHERE quality > 0)
    SELECT query_id, {_int('quality')} AS top_score, kind AS top_type FROM f WHERE stopped = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, n) = 1""")
def verify_keys(spark: SparkSession, d: str) -> DataFrame:
    """The verdict on each query's best candidate, each query with a keyword of its own."""
    rows = fixtures.documents(spark, d).select((F.col("doc_id") % 50).alias("query_id"), F.col("doc_id").alias("pos"), F.lit("u").alias("url"), F.col("text").alias("preview"))
    verified = select.verify(rows.withColumn("keyword", _key(F.col("query_id"))))
    return select.content_verdict(verified).withColumn("top_score", T.scaled(F.col("top_score")))


_JUDGED = f"""@source@, g AS (SELECT *, length(text) > ([50, 100, 0, 100, 200, 50, 50])[stage_index + 1] AND NOT (stage_index = 0 AND {_has('substr(text, 1, 2000)', _PUA)}) AS good FROM stages),
    c AS (SELECT *, CASE WHEN good THEN {_completeness(_strip('text'))} ELSE 0e0 END AS own FROM g),
    e AS (SELECT *, coalesce(max(CASE WHEN good THEN own END) OVER (PARTITION BY query_id, url_rank ORDER BY stage_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= @least@, false) AS enough FROM c),
    b AS (SELECT *, coalesce(max(CASE WHEN stage_index = 2 THEN CAST(NOT enough AS INTEGER) END) OVER (PARTITION BY query_id, url_rank), 0) = 1 AS opened, stage_index IN (1, 2) AND enough AS skipped FROM e),
    j AS (SELECT *, good AND NOT skipped AND (stage_index < 3 OR opened) AS effective FROM b),
    l AS MATERIALIZED (SELECT *, {_normal('text')} AS nx, {_normal('preview')} AS ny FROM j),
    v AS (SELECT * EXCLUDE (nx, ny), effective AND {_valid('text', '@least@')} AND (length(text) < 200 OR length(preview) < 200 OR {_agrees('nx', 'ny')}) AS passes, dense_rank() OVER (PARTITION BY query_id ORDER BY url_rank) AS nth FROM l),
    x AS (SELECT *, coalesce(sum(CAST(passes AND own >= @least@ AS INTEGER)) OVER (PARTITION BY query_id ORDER BY url_rank, stage_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM v WHERE nth <= 3),
    r AS (SELECT * FROM x WHERE ended = 0)"""
_CHAIN = f"""w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (passes AND own > 0) DESC, (effective AND own > 0) DESC, own DESC, url_rank, stage_index) AS p,
        count(*) OVER (PARTITION BY query_id) AS attempted, count_if(effective) OVER (PARTITION BY query_id) AS succeeded FROM r)
    SELECT query_id, CASE WHEN effective AND own > 0 THEN url END AS url, CASE WHEN effective AND own > 0 THEN stage_name END AS winning_stage, CASE WHEN effective AND own > 0 THEN text ELSE '' END AS text,
        CASE WHEN effective AND own > 0 THEN {_int('own')} ELSE 0 END AS completeness, coalesce(passes AND own >= @least@, false) AS success,
        CASE WHEN passes AND own > 0 THEN 'validated' WHEN effective AND own > 0 THEN 'best_effort' ELSE 'none' END AS result, attempted, succeeded FROM w WHERE p = 1"""


def _staged(sql: str, least: str = "3e-1") -> str:
    return sql.replace("@source@", _with("stages")).replace("@least@", least)



@query("fallback_chain", f"WITH {_staged(_JUDGED)}, {_staged(_CHAIN)}")
def fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    return select.chain(fixtures.stage_outputs(spark, d), None, 0.3).withColumn("completeness", T.scaled(F.col("completeness")))


@query("chain_failures", f"""WITH {_staged(_JUDGED, "6e-1")}, u AS (SELECT query_id, url_rank, url, count(*) AS attempted, max(CASE WHEN effective THEN own ELSE 0e0 END) AS best, count_if(passes AND own > 0) AS ok FROM r GROUP BY ALL),
    f AS (SELECT *, sum(ok) OVER (PARTITION BY query_id ORDER BY url_rank) AS found FROM u) SELECT query_id, url_rank, url, attempted, {_int('best')} AS best_completeness FROM f WHERE found = 0""")
def chain_failures(spark: SparkSession, d: str) -> DataFrame:
    return select.failures(fixtures.stage_outputs(spark, d), None, 0.6).withColumn("best_completeness", T.scaled(F.col("best_completeness")))


@query("stage_skip", f"WITH {_staged(_JUDGED)} SELECT query_id, url_rank, stage_index, skipped, effective, passes, {_int('own')} AS completeness FROM v")
def stage_skip(spark: SparkSession, d: str) -> DataFrame:
    rows = select.judged(fixtures.stage_outputs(spark, d), None, 0.3)
    return rows.select("query_id", "url_rank", "stage_index", "skipped", "effective", "passes", T.scaled(F.col("completeness")).alias("completeness"))


_LAYERS = f"""{_with("docs")}, y AS (SELECT doc_id // 6 AS key, CAST(doc_id % 6 + 1 AS INTEGER) AS layer, text, doc_id AS pos FROM docs),
    n AS (SELECT *, length({_strip("text")}) AS n, {_completeness(_strip("text"))} AS own, list_position([1, 3, 6, 2, 4, 5], layer) AS place FROM y),
    t AS (SELECT *, CASE WHEN own >= 5e-1 THEN 1 WHEN layer IN (1, 3, 6) AND n > 100 THEN 2 WHEN layer = 2 AND NOT starts_with({_strip("text")}, '{{') AND n > 100 THEN 3 WHEN n > 50 THEN 4 END AS tier FROM n)"""


def _layers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return fixtures.documents(spark, d).select(F.floor(i / 6).alias("key"), (i % 6 + 1).cast("int").alias("layer"), "text", i.alias("pos"))


@query("layer_pick_best", f"""WITH {_LAYERS} SELECT key, layer, pos, tier FROM t WHERE tier IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY tier, CASE WHEN tier = 1 THEN place ELSE -length(text) END, pos) = 1""")
def layer_pick_best(spark: SparkSession, d: str) -> DataFrame:
    return select.pick_layer(_layers(spark, d)).select("key", "layer", "pos", "tier")


@query("layer_confidence", f"""WITH {_LAYERS} SELECT pos, {_int("CASE layer WHEN 1 THEN CASE WHEN own >= 5e-1 THEN 9e-1 ELSE 3e-1 END WHEN 2 THEN CASE WHEN length(text) > 50 THEN 7e-1 ELSE 4e-1 END WHEN 3 THEN 8e-1 WHEN 4 THEN 5e-1 WHEN 5 THEN 6e-1 ELSE 75e-2 END")} AS confidence FROM n""")
def layer_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _layers(spark, d).select("pos", T.scaled(select.layer_confidence(F.col("layer"), F.col("text"))).alias("confidence"))


@query("ocr_best", f"""WITH {_with("docs")}, f AS (SELECT doc_id // 24 AS key, CAST(doc_id % 24 // 4 AS INTEGER) AS frame, CAST(doc_id % 4 AS INTEGER) AS provider, text, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 11) / 1e1 END AS c FROM docs),
    g AS (SELECT key, frame, provider, text, coalesce(c, 6e-1) AS c FROM f WHERE frame < 5 AND provider < 2 AND length(text) > 50),
    h AS (SELECT *, coalesce(max(CAST(c > 6e-1 AS INTEGER)) OVER (PARTITION BY key, frame ORDER BY provider ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM g),
    b AS (SELECT * FROM h WHERE done = 0 QUALIFY row_number() OVER (PARTITION BY key, frame ORDER BY c DESC, provider) = 1)
    SELECT key, string_agg(text, chr(10) || '---' || chr(10) ORDER BY frame) AS text FROM b WHERE c >= 6e-1 GROUP BY 1""")
def ocr_best(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = fixtures.documents(spark, d).select(F.floor(i / 24).alias("key"), F.floor(i % 24 / 4).cast("int").alias("frame"), (i % 4).cast("int").alias("provider"), "text", F.when(i % 5 != 0, i % 11 / 10).alias("confidence"))
    return select.joined_readings(select.pick_reading(rows))


@query("frame_batches", """WITH f AS (SELECT conv_id AS key, turn AS frame, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS batch FROM conversations)
    SELECT key, CAST(batch AS INTEGER) AS batch, string_agg(frame, ',' ORDER BY frame) AS frames, count(*) AS count FROM f GROUP BY 1, 2""")
def frame_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("key"), F.col("turn").alias("frame"))
    return select.frame_batches(rows).withColumn("frames", F.array_join("frames", ","))


_DUMPS = ["", '{"title": "x"} ', '{"version": 1} ', "<3 ", "<p>x</p> ", "PG", '"events": 1 ', '["a"] ', ' {"disable": 1} ', '"encryptAttrs" ']


@query("heap_string", f"""WITH {_with("docs")}, p AS (SELECT doc_id, ({_list_of(_DUMPS)})[CAST(doc_id % {len(_DUMPS)} AS INTEGER) + 1] || text AS text FROM docs),
    f AS (SELECT doc_id // 9 AS key, doc_id AS pos, text, {_strip("text")} AS t, row_number() OVER (PARTITION BY doc_id // 9 ORDER BY length(text) DESC, doc_id) AS r FROM p QUALIFY r <= 5)
    SELECT key, pos FROM f WHERE length(text) >= 200 AND NOT (starts_with(t, '{{') AND (contains(substr(text, 1, 200), '"version"') OR contains(substr(text, 1, 500), '"disable"'))) AND NOT contains(substr(text, 1, 500), '"encryptAttrs"')
        AND NOT contains(substr(text, 1, 500), '"events"') AND NOT (starts_with(t, 'PG') AND length(text) > 500) AND NOT (starts_with(t, '<') AND (contains(text, '</') OR contains(text, '/>'))) QUALIFY row_number() OVER (PARTITION BY key ORDER BY r) = 1""")
def heap_string(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.concat(F.element_at(F.array(*[F.lit(x) for x in _DUMPS]), (i % len(_DUMPS)).cast("int") + 1), "text")
    return select.heap_string(fixtures.documents(spark, d).select(F.floor(i / 9).alias("key"), i.alias("pos"), text.alias("text"))).select("key", "pos")


@query("layer_first", f"""WITH {_LAYERS} SELECT key, layer, {_strip("text")} AS text FROM n WHERE n > 50 QUALIFY row_number() OVER (PARTITION BY key ORDER BY place, pos) = 1""")
def layer_first(spark: SparkSession, d: str) -> DataFrame:
    return select.first_layer(_layers(spark, d))


@query("layer_quick", f"""WITH {_LAYERS}, e AS (SELECT key, arg_min({_strip("text")}, pos) AS text FROM n WHERE layer = 1 AND own >= 5e-1 GROUP BY 1)
    SELECT key, CAST(1 AS INTEGER) AS layer, text, CAST(0 AS INTEGER) AS tier FROM e UNION ALL
    SELECT key, layer, {_strip("text")}, tier FROM t WHERE tier IS NOT NULL AND key NOT IN (SELECT key FROM e) QUALIFY row_number() OVER (PARTITION BY key ORDER BY tier, CASE WHEN tier = 1 THEN place ELSE -length(text) END, pos) = 1""")
def layer_quick(spark: SparkSession, d: str) -> DataFrame:
    return select.quick_or_full(_layers(spark, d))


@query("ocr_first", f"""WITH {_with("docs")}, f AS (SELECT doc_id // 24 AS key, CAST(doc_id % 24 // 4 AS INTEGER) AS frame, CAST(doc_id % 4 AS INTEGER) AS provider, CASE WHEN doc_id % 3 = 0 THEN ' too short ' ELSE {_strip("text")} END AS t FROM docs),
    g AS (SELECT * FROM f WHERE length({_strip("t")}) > 20 QUALIFY row_number() OVER (PARTITION BY key, frame ORDER BY provider) = 1), j AS (SELECT key, string_agg(t, chr(10) || chr(10) ORDER BY frame) AS t FROM g GROUP BY 1),
    o AS (SELECT key, regexp_replace(regexp_replace(regexp_replace(t, ' {{3,}}', '  ', 'g'), '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '\\r\\n?', chr(10), 'g') AS o FROM j)
    SELECT key, {_strip("regexp_replace(o, '" + chr(92) + "n{4,}', chr(10) || chr(10) || chr(10), 'g')")} AS text FROM o""")
def ocr_first(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.when(i % 3 == 0, " too short ").otherwise(F.col("text"))
    return select.first_readings(fixtures.documents(spark, d).select(F.floor(i / 24).alias("key"), F.floor(i % 24 / 4).cast("int").alias("frame"), (i % 4).cast("int").alias("provider"), text.alias("text")))


@query("multi_pass", f"""WITH {_with("docs")}, f AS (SELECT doc_id // 4 AS key, doc_id % 4 AS p, text, {_completeness(_strip("text"))} AS s FROM docs WHERE doc_id % 4 < 3),
    g AS (SELECT *, coalesce(max(CAST(s >= 45e-2 AS INTEGER)) OVER (PARTITION BY key ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM f)
    SELECT key, {_int("s")} AS score, passes, text FROM (SELECT *, count(*) OVER (PARTITION BY key) AS passes FROM g WHERE done = 0) QUALIFY row_number() OVER (PARTITION BY key ORDER BY s DESC, p) = 1""")
def multi_pass(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.documents(spark, d).select(F.floor(F.col("doc_id") / 4).alias("key"), (F.col("doc_id") % 4).alias("pass"), "text")
    return select.passes_until(rows, 0.45).select("key", T.scaled(F.col("score")).alias("score"), "passes", "text")


def _run_sql(keywords: str, quality: str, word: str) -> str:
    """Every document is a text of one address and stage: by doc_id modulo seven times the number of addresses."""
    judged = _staged(_JUDGED).replace(_with("stages"), "")
    return f"""WITH {_MERGED}, {_with("docs")}, pv AS ({_VERDICT.replace("@from@", "top")}),
    pa AS (SELECT url, row_number() OVER (ORDER BY url) - 1 AS r, count(*) OVER () AS m FROM (SELECT DISTINCT url FROM serp)),
    pd AS (SELECT url, doc_id, text, CAST(doc_id % (7 * m) % 7 AS INTEGER) AS i FROM docs JOIN pa ON doc_id % (7 * m) // 7 = r),
    pp AS (SELECT url, arg_min(text, doc_id) AS preview FROM pd GROUP BY 1), po AS (SELECT url, i, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM pd GROUP BY 1, 2),
    pc AS (SELECT query_id, pv.rank AS pos, url, preview, {_strip("preview")} AS t{keywords} FROM pv JOIN pp USING (url) WHERE is_content OR type = 'novel_index'),
    ps AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, url) AS n FROM pc QUALIFY n <= 10), pk AS ({_typed("ps")}),
    pq AS (SELECT *, {quality} - CASE WHEN kind = 'novel_index' THEN 3e-1 ELSE 0e0 END AS quality FROM pk WHERE length(t) >= 50),
    pf AS (SELECT *, {"coalesce(sum(CAST(quality >= 7e-1 AND " + word + " AS INTEGER)) OVER (PARTITION BY query_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)" if word else "0"} AS stopped FROM pq WHERE quality > 0),
    pw AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, n) AS INTEGER) AS url_rank FROM pf WHERE stopped = 0 QUALIFY url_rank <= 3),
    stages AS (SELECT query_id, url_rank, url, i AS stage_index, 'stage' || i AS stage_name, text, substr(preview, 1, 2000) AS preview{", keyword" if keywords else ""} FROM pw JOIN po USING (url))
    {judged}, {_staged(_CHAIN)}"""


def _run(spark: SparkSession, d: str, keywords: DataFrame | None = None) -> DataFrame:
    results, docs = fixtures.serp(spark, d), fixtures.documents(spark, d)
    urls = results.select("url").distinct()
    m = urls.count()
    # the addresses are few (a hundred whatever the scale), so one task may number them
    numbered = urls.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("url")) - 1)
    texts = docs.withColumn("i", (F.col("doc_id") % (7 * m) % 7).cast("int")).join(numbered, F.floor(F.col("doc_id") % (7 * m) / 7) == F.col("r"))
    previews = texts.groupBy("url").agg(F.min_by("text", "doc_id").alias("preview"))
    stages = texts.groupBy("url", F.col("i").alias("stage_index")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("t"))
    stages = stages.select("url", "stage_index", F.concat(F.lit("stage"), F.col("stage_index").cast("string")).alias("stage_name"), F.array_join("t.text", "\n").alias("text"))
    return pipeline.run(results, previews, stages, pipeline.Config(min_completeness=0.3), keywords).withColumn("completeness", T.scaled(F.col("completeness")))


@query("run_pipeline", _run_sql("", _quality(), ""))
def run_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d)


_LINK = "(?is)<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>"
_ANCHORS = f"""{_with("html")}, a AS (SELECT page_id, url, coalesce(nullif(regexp_extract(html, '(?i)<base\\s[^>]*href\\s*=\\s*["'']([^"'']+)["'']', 1), ''), url) AS base,
        regexp_extract_all(html, '{_LINK}', 1) AS h, regexp_extract_all(html, '{_LINK}', 2) AS t FROM html),
    b AS (SELECT page_id, url, base, unnest(range(len(h))) AS pos, trim(unnest(h)) AS href, unnest(t) AS t FROM a),
    c AS (SELECT page_id, url, base, pos, href, {_strip("regexp_replace(t, '<[^>]+>', '', 'g')")} AS label FROM b)"""
_RESOLVED = """r AS (SELECT * EXCLUDE (u), CASE WHEN contains(u, '/../') THEN regexp_replace(u, '/[^/]+/\\.\\./', '/') ELSE u END AS abs_url FROM (SELECT *, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(base, '^[a-z]+:') || href
        WHEN starts_with(href, '/') THEN regexp_extract(base, '^([a-z]+://[^/?#]*)', 1) || href
        WHEN starts_with(href, '?') THEN regexp_extract(base, '^([^?#]*)', 1) || href WHEN starts_with(href, '#') THEN regexp_extract(base, '^([^#]*)', 1) || href
        ELSE regexp_extract(regexp_extract(base, '^([^?#]*)', 1), '^(.*/)', 1) || href END AS u FROM c WHERE label <> '' AND href <> '' AND NOT starts_with(lower(href), 'javascript:'))),
    f AS (SELECT * FROM r WHERE regexp_matches(abs_url, '^https?://') QUALIFY row_number() OVER (PARTITION BY page_id, abs_url ORDER BY pos) = 1),
    k AS (SELECT *, regexp_extract(label, '(\\p{Nd}+)', 1) AS n FROM f)"""
_DISCOVERED = """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN n = '' THEN label WHEN length(n) >= 8 THEN n ELSE lpad(n, 8, '0') END, pos) AS INTEGER) AS rank, label, abs_url FROM k WHERE """


@query("link_discovery", f"WITH {_ANCHORS}, {_RESOLVED} {_DISCOVERED}" + " OR ".join(_has("label", p, icase=i) for p, i in rules.CHAPTER_LINKS))
def link_discovery(spark: SparkSession, d: str) -> DataFrame:
    return links.discover(fixtures.pages(spark, d))


@query("link_pattern", f"WITH {_ANCHORS}, {_RESOLVED} {_DISCOVERED} ({_has('label', 'th')} OR {_has('href', 'th')}) QUALIFY rank <= 3")
def link_pattern(spark: SparkSession, d: str) -> DataFrame:
    return links.discover(fixtures.pages(spark, d), "th", 3)


@query("page_links", f"""WITH {_ANCHORS}, n AS (SELECT * FROM c WHERE href <> '' AND href <> '#' AND NOT starts_with(href, 'javascript:'))
    SELECT url, arg_min(href, pos) FILTER (regexp_matches(label, '^(下一页|下一頁)$')) AS next_page, arg_min(href, pos) FILTER (regexp_matches(label, '下一章|下一节')) AS next_chapter FROM n GROUP BY 1""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return links.page_links(fixtures.pages(spark, d))


@query("page_follow", f"""WITH RECURSIVE p AS (SELECT *, conv_id || '/' || turn AS url FROM conversations),
    e AS (SELECT url, CASE WHEN turn % 13 = 12 THEN conv_id || '/0' ELSE lead(url) OVER (PARTITION BY conv_id ORDER BY turn) END AS next_page, CASE WHEN turn % 17 = 16 THEN '/next' END AS next_chapter,
        regexp_replace(CASE turn % 5 WHEN 3 THEN '' WHEN 2 THEN text || ' 加入书架 x' ELSE text END, '({rules.TAIL_WORDS})[^\\n]*', '', 'g') AS text FROM p),
    w(start, here, path) AS (SELECT url, url, [url] FROM e UNION ALL SELECT w.start, e.next_page, list_append(w.path, e.next_page) FROM w JOIN e ON w.here = e.url WHERE e.next_chapter IS NULL AND e.next_page IS NOT NULL AND NOT list_contains(w.path, e.next_page) AND len(w.path) < 10)
    SELECT start, CAST(max(len(path)) AS INTEGER) AS pages, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY len(path)) FILTER (text <> ''), '') AS text FROM w JOIN e ON w.here = e.url GROUP BY 1""")
def page_follow(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    at = F.concat(F.col("conv_id").cast("string"), F.lit("/"), t.cast("string"))
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text", at.alias("url"))
    ahead = F.lead("url").over(Window.partitionBy("conv_id").orderBy("turn"))
    nav = rows.select("url", F.when(t % 13 == 12, F.concat(F.col("conv_id").cast("string"), F.lit("/0"))).otherwise(ahead).alias("next_page"), F.when(t % 17 == 16, "/next").alias("next_chapter"))
    return links.follow(nav, rows.select("url", F.when(t % 5 == 3, "").when(t % 5 == 2, F.concat("text", F.lit(" 加入书架 x"))).otherwise(F.col("text")).alias("text")))


@query("crawl_merge", """WITH i AS (SELECT doc_id // 20 AS key, doc_id % 20 AS idx, CASE WHEN doc_id % 20 = 7 THEN 'x' ELSE '第' || (doc_id % 15) || '章 名' END AS label, 'https://site.example/' || doc_id AS url, CASE WHEN doc_id // 20 % 5 = 4 THEN 'short' ELSE text END AS text FROM documents),
    s AS (SELECT *, CASE WHEN label = 'x' THEN 'i' || lpad(CAST(idx AS VARCHAR), 6, '0') ELSE 'n' || lpad(regexp_extract(label, '[0-9]+'), 6, '0') END AS slug FROM i),
    f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key, slug ORDER BY idx) = 1),
    b AS (SELECT key, count(*) AS total, count_if(length(text) > 100) AS extracted, coalesce(CAST(sum(length(text)) FILTER (length(text) > 100) AS BIGINT), 0) AS total_chars, coalesce(string_agg('## ' || label || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY idx) FILTER (length(text) > 100), '') AS body, arg_min(label, idx) FILTER (length(text) > 100) AS label FROM f GROUP BY 1)
    SELECT key, total, extracted, total - extracted AS failed, total_chars, '# ' || CASE WHEN label IS NULL THEN 'site.example' WHEN label = 'x' THEN 'x' ELSE '名' END || chr(10) || chr(10) || CASE WHEN total_chars > 0 THEN '共 ' || extracted || ' 篇 | 总字数约 ' || format('{:,}', total_chars) || ' | 来源：site.example' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || body AS markdown FROM b""")
def crawl_merge(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    label = F.when(i % 20 == 7, "x").otherwise(F.concat(F.lit("第"), (i % 15).cast("string"), F.lit("章 名")))
    text = F.when(F.floor(i / 20) % 5 == 4, "short").otherwise(F.col("text"))
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.floor(i / 20).alias("key"), (i % 20).alias("idx"), label.alias("label"), F.concat(F.lit("https://site.example/"), i.cast("string")).alias("url"), text.alias("text"))
    return links.crawl_document(rows)


#: lines of a contents page; @ is its number, ¤ its number in Chinese numerals
_CONTENTS = ["第 @ 章 起 first", 'HREF = "/a/@.html" and https://abs.example/@', "第¤节w", '<a href="b/@.html">', "https://late.example/@", "text of @", "第十二回 终", ".", ".", "第二卷 x https://v.example/@ 'q'", "第百部"]


def _contents(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.replace(F.replace(F.lit("\n".join(_CONTENTS)), F.lit("@"), i.cast("string")), F.lit("¤"), rx.strip(_numeral(i)))
    text = F.concat(text, F.lit("\n"), "text")
    return spark.read.parquet(f"{d}/documents.parquet").select(i.alias("key"), F.when(i % 2 == 0, F.concat(F.lit("https://s.example/dir/"), i.cast("string"), F.lit(".html"))).otherwise("https://s.example/dir/").alias("base"), text.alias("text"))


_CHAPTER_HEAD = r"第\s*([一二三四五六七八九十百千\d]+)\s*[章节回卷部]\s*(.*?)(?:\s|$)"
_ADDRESS = lambda c: f"""coalesce(nullif(regexp_extract({c}, {_p("(https?://[^" + chr(92) + "s" + chr(34) + "']+)")}, 1), ''), nullif(regexp_extract({c}, '(?i)href\\s*=\\s*"([^"]+)"', 1), ''))"""


@query("chapter_lines", f"""WITH {_NUMERAL}, c AS (SELECT doc_id AS key, CASE WHEN doc_id % 2 = 0 THEN 'https://s.example/dir/' || doc_id || '.html' ELSE 'https://s.example/dir/' END AS base,
        string_split(replace(replace({_q(chr(10).join(_CONTENTS))}, '@', CAST(doc_id AS VARCHAR)), '¤', {_strip('numeral')}) || chr(10) || text, chr(10)) AS ls FROM documents JOIN n ON doc_id = i),
    l AS (SELECT key, base, unnest(range(len(ls))) AS pos, unnest(ls) AS line, unnest(list_append(ls[2:], '')) AS line1, unnest(list_concat(ls[3:], ['', ''])) AS line2 FROM c),
    h AS (SELECT *, {_strip(f"regexp_extract(line, {_p(_CHAPTER_HEAD)}, 1)")} AS t, substr({_strip(f"regexp_extract(line, {_p(_CHAPTER_HEAD)}, 2)")}, 1, 60) AS title FROM l WHERE {_has('line', _CHAPTER_HEAD)}),
    v AS (SELECT *, {_number('t')} AS number, coalesce({_ADDRESS('line')}, {_ADDRESS('line1')}, {_ADDRESS('line2')}) AS u FROM h),
    g AS (SELECT *, coalesce(u, CASE WHEN regexp_matches(base, '^(.+/)([0-9]+)(\\.html?)?$') THEN regexp_replace(base, '^(.+/)([0-9]+)(\\.html?)?$', '\\1' || number || '\\3') ELSE rtrim(base, '/') || '/' || number || '.html' END) AS u2 FROM v)
    SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY number, pos) AS INTEGER) AS rank, CAST(pos AS INTEGER) AS pos, number, title, CASE WHEN starts_with(u2, 'http') THEN u2 WHEN starts_with(u2, '/') THEN 'https://s.example' || u2 ELSE 'https://s.example/dir/' || u2 END AS url FROM g""")
def chapter_lines(spark: SparkSession, d: str) -> DataFrame:
    return links.chapter_lines(_contents(spark, d))


def _toc(spark: SparkSession, d: str) -> DataFrame:
    """Every page with links to some chapters put before it: page_id % 6 + 1 of them, from page_id % 9 on, the first of
    them again at the end, and a script."""
    k = F.col("page_id")
    link = lambda n: F.concat(F.lit("<a href='/c/"), n.cast("string"), F.lit(".html'>第"), n.cast("string"), F.lit("章 t</a>"))
    chapters = F.array_join(F.transform(F.sequence(k % 9, k % 9 + k % 6), link), " ")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", F.concat(F.lit('<a href="javascript:x">第99章</a>'), chapters, F.lit('<a href="again">第'), (k % 9).cast("string"), F.lit("章</a>"), "html").alias("html"))


_TOC = f"""html AS (SELECT page_id, url, '<a href="javascript:x">第99章</a>' || array_to_string(list_transform(range(page_id % 9, page_id % 9 + page_id % 6 + 1), lambda n: '<a href=''/c/' || n || '.html''>第' || n || '章 t</a>'), ' ') || '<a href="again">第' || (page_id % 9) || '章</a>' || html AS html FROM pages),
    {_ANCHORS.split(', a AS (')[1].join(['a AS (', ''])}"""
_HOST = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


@query("chapter_harvest", f"""WITH {_TOC}, f AS (SELECT url, pos, label, href, CAST(regexp_extract(label, '第\\s*([0-9]+)\\s*章', 1) AS BIGINT) AS number FROM c WHERE regexp_matches(label, '第\\s*[0-9]+\\s*章') AND href <> '' AND NOT starts_with(href, 'javascript:')),
    o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY url, number ORDER BY pos) = 1), k AS (SELECT *, count(*) OVER (PARTITION BY url) AS found FROM o)
    SELECT url, greatest(number, 1) AS number, label AS title, {_HOST} || href AS chapter_url FROM k WHERE found >= 3 AND number > 0""")
def chapter_harvest(spark: SparkSession, d: str) -> DataFrame:
    return links.harvest(_toc(spark, d)).where("number > 0")


@query("first_chapter", f"""WITH {_TOC}, f AS (SELECT url, arg_min(label, pos) AS label, arg_min(href, pos) AS href FROM c WHERE regexp_matches(label, '第[0-9]+[章节回卷部]') AND href <> '' GROUP BY 1)
    SELECT url, substr(label, 1, 60) AS title, href AS chapter_url FROM f""")
def first_chapter(spark: SparkSession, d: str) -> DataFrame:
    return links.first_chapter(_toc(spark, d))


@query("resume_crawl", "SELECT url FROM pages EXCEPT SELECT url FROM pages WHERE page_id % 3 = 0")
def resume_crawl(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return links.remaining(pages.select("url").distinct(), pages.where("page_id % 3 = 0").select("url"), "url")


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    """Three copies of all documents as chapters, 30 to a work, the later ones with gaps and changes."""
    rows = spark.read.parquet(f"{d}/documents.parquet").withColumn("work_id", F.floor(F.col("doc_id") / 30)).withColumn("n", F.row_number().over(Window.partitionBy("work_id").orderBy("doc_id")))
    copies = rows.select("work_id", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("source_idx"), F.col("n").alias("ordinal"), "text")
    copies = copies.where((F.col("source_idx") == 0) | (F.col("ordinal") % (F.col("source_idx") + 2) != 0))
    text = F.when(F.col("source_idx") == 1, F.concat(F.lit("x "), F.col("text"))).when(F.col("source_idx") == 2, F.substr("text", F.lit(20))).otherwise(F.col("text"))
    return copies.select("work_id", "source_idx", "ordinal", F.concat(F.lit("s"), F.col("source_idx").cast("string")).alias("source_name"), F.lit("").alias("title"), text.alias("text"))


@query("chapter_align")
def chapter_align(spark: SparkSession, d: str) -> DataFrame:
    return align.align(_chapters(spark, d))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents three to a row, 30 to a work."""
    i = F.col("doc_id")
    return spark.read.parquet(f"{d}/documents.parquet").select(F.floor(i / 30).alias("work_id"), F.floor(i % 30 / 3).cast("int").alias("row"), (i % 3).cast("int").alias("source_idx"), F.concat(F.lit("s"), (i % 3).cast("string")).alias("source_name"), F.lit("").alias("title"), "text")


_MERGE = """WITH r AS (SELECT doc_id // 30 AS work_id, CAST(doc_id % 30 // 3 AS INTEGER) AS row, CAST(doc_id % 3 AS INTEGER) AS i, text, length(text) AS n FROM documents WHERE length(text) > 0),
    m AS (SELECT *, list_sort(list(n) OVER (PARTITION BY work_id, row)) AS ns FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY work_id, row ORDER BY {order}, i) AS p FROM m),
    b AS (SELECT work_id, row, arg_min(text, p) AS best, arg_min(n, p) AS bn, arg_min(i, p) AS bi FROM o GROUP BY ALL),
    g AS (SELECT work_id, row, any_value(best) || coalesce(string_agg(chr(10) || chr(10) || '[补充内容 from s' || i || ']' || chr(10) || text, '' ORDER BY i) FILTER (p > 1 AND n > bn * 13e-1), '') AS t,
        count(*) AS k, count_if(p > 1 AND n > bn * 13e-1) AS more, 's' || any_value(bi) || coalesce(string_agg(',s' || i, '' ORDER BY i) FILTER (p > 1 AND n > bn * 13e-1), '') AS sources FROM o JOIN b USING (work_id, row) GROUP BY ALL)
    SELECT work_id, row AS num, '第' || row || '章' AS title, @strip@ AS text, sources, CASE WHEN k = 1 THEN 10000 WHEN more > 0 THEN 7000 ELSE 9000 END AS confidence FROM g"""


_MERGE = _MERGE.replace("@strip@", _strip("regexp_replace(t, '" + chr(92) + "n{4,}', chr(10) || chr(10) || chr(10), 'g')"))


def _merge(strategy: str) -> Query:
    return lambda s, d: align.merge(_rows(s, d), strategy).withColumn("confidence", T.scaled(F.col("confidence"))).withColumn("sources", F.array_join("sources", ","))


QUERIES["chapter_merge_longest"], SQL["chapter_merge_longest"] = _merge("longest"), _MERGE.replace("{order}", "n DESC")
QUERIES["chapter_merge_consistent"], SQL["chapter_merge_consistent"] = _merge("most_consistent"), _MERGE.replace("{order}", "abs(n - ns[len(ns) // 2 + 1])")
QUERIES["chapter_merge_voting"] = _merge("voting")


@query("source_diff")
def source_diff(spark: SparkSession, d: str) -> DataFrame:
    return align.differences(_rows(spark, d))


@query("merge_summary", _MERGE.replace("{order}", "n DESC").replace("SELECT work_id, row AS num", "SELECT work_id, count(*) AS chapters, CAST(sum(length(text)) AS BIGINT) AS total_chars, CAST(floor(avg(confidence) + 5e-1) AS BIGINT) AS confidence FROM (SELECT work_id, row AS num") + ") GROUP BY 1")
def merge_summary(spark: SparkSession, d: str) -> DataFrame:
    return align.summary(align.merge(_rows(spark, d))).withColumn("confidence", T.scaled(F.col("confidence")))


#: over the 800 characters that auto_clean compares, without a period
_TAIL = "\n====" + "".join(f"\nsee also: chapter {k} of this book, and the index" for k in range(1, 21))


@query("auto_clean")
def auto_clean(spark: SparkSession, d: str) -> DataFrame:
    return align.auto_clean(_book(spark, d))


def _book(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    part = F.concat("text", F.when(i % 10 < 7, _TAIL).otherwise(""))
    rows = spark.read.parquet(f"{d}/documents.parquet").groupBy(F.floor(i / 10).alias("key")).agg(F.array_sort(F.collect_list(F.struct("doc_id", part.alias("p")))).alias("a"))
    return rows.select("key", F.array_join(F.col("a.p"), "\n============\n第1章\n============\n").alias("text"))


_SITES = [*rules.PLATFORMS, "other"]
_CITIES = ["北京", "武汉", "长沙", "上海"]


def _site_sql() -> str:
    """(platform, template, city, code) of every platform and city above, as far as there are codes."""
    rows = [(p, t, c, codes.get(c, c)) for p, (t, _, codes) in rules.PLATFORMS.items() for c in _CITIES]
    return "(VALUES " + ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows) + ") s(platform, template, city, code)"


@query("job_urls", f"""WITH w AS (SELECT doc_id, ({_list_of(_SITES)})[CAST(doc_id % {len(_SITES)} AS INTEGER) + 1] AS platform, ({_list_of(_CITIES)})[CAST(doc_id // 7 % 4 AS INTEGER) + 1] AS city, substr(text, 1, 12) || ' 工程' AS keyword, CAST(doc_id AS INTEGER) AS page FROM documents)
    SELECT platform, keyword, city, page, replace(replace(replace(replace(template, '{{keyword}}', keyword), '{{city_code}}', code), '{{city}}', city), '{{page}}', CAST(page AS VARCHAR)) AS url FROM w JOIN {_site_sql()} USING (platform, city)""")
def job_urls(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int") + 1)
    i = F.col("doc_id")
    wanted = spark.read.parquet(f"{d}/documents.parquet").select(pick(_SITES, i).alias("platform"), pick(_CITIES, F.floor(i / 7)).alias("city"), F.concat(F.substring("text", 1, 12), F.lit(" 工程")).alias("keyword"), i.cast("int").alias("page"))
    return jobs.search_urls(wanted)


#: models' answers by doc_id % 6: bare, fenced, in prose, none, empty, missing; @ is doc_id
_RESPONSES = ['{"title": "Engineer @", "company": "Acme @", "requirements": ["a@", "b"], "tech_stack": ["x@", "y"], "education": "E@"}', '```json\n{"title": "Lead @", "salary": "@k"}\n```', 'Here it is: {"title": "Nurse @", "location": "Paris @", "benefits": []} bye', "no json here @", "{}", None]


def _postings(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    answer = F.replace(F.element_at(F.array(*[F.lit(r) for r in _RESPONSES]), (i % 6).cast("int") + 1), F.lit("@"), i.cast("string"))
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.when(i % 5 == 0, F.substring("text", 1, 40)).otherwise(F.col("text")).alias("text"), answer.alias("response"))
    return rows.select("doc_id", jobs.parse("response", "text", F.lit("u")).alias("job"))


_JSON = lambda f: f"coalesce(j->>'$.{f}', '')"
_PARSED = f"""s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, 40) ELSE text END AS text, replace(([{', '.join('NULL' if r is None else _q(r) for r in _RESPONSES)}])[CAST(doc_id % 6 AS INTEGER) + 1], '@', CAST(doc_id AS VARCHAR)) AS r FROM documents),
    p AS (SELECT doc_id, r, length({_strip("text")}) >= 50 AS enough, substr(string_split({_strip("text")}, chr(10))[1], 1, 80) AS first, length(text) AS n, TRY_CAST(nullif(regexp_extract(r, '(?s)\\{{.*\\}}'), '') AS JSON) AS j FROM s),
    j AS (SELECT doc_id, n, CASE WHEN NOT enough THEN '' WHEN r IS NULL THEN first ELSE {_JSON('title')} END AS title, {', '.join(f"CASE WHEN enough THEN {_JSON(f)} ELSE '' END AS {f}" for f in ('company', 'salary', 'location', 'education'))},
        {', '.join(f"CASE WHEN enough THEN coalesce(CAST(j->'$.{f}' AS VARCHAR[]), []) ELSE [] END AS {f}" for f in ('requirements', 'tech_stack'))} FROM p)"""


@query("jd_parse", f"WITH {_PARSED} SELECT doc_id, title, company, salary, location, education, array_to_string(requirements, ',') AS requirements, CAST(n AS INTEGER) AS raw_length FROM j")
def jd_parse(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).select("doc_id", "job.title", "job.company", "job.salary", "job.location", "job.education", F.array_join("job.requirements", ",").alias("requirements"), "job.raw_length")


@query("jd_text", f"""WITH {_PARSED} SELECT doc_id, concat_ws(chr(10), CASE WHEN title <> '' THEN '【' || title || '】' END, CASE WHEN company <> '' THEN '公司：' || company END, CASE WHEN salary <> '' THEN '薪资：' || salary END,
    CASE WHEN location <> '' THEN '地点：' || location END, CASE WHEN education <> '' THEN '学历：' || education END, CASE WHEN len(requirements) > 0 THEN chr(10) || '要求：' || chr(10) || '  ' || array_to_string(requirements, chr(10) || '  ') END,
    CASE WHEN len(tech_stack) > 0 THEN chr(10) || '技术栈：' || array_to_string(tech_stack, ', ') END) AS text FROM j""")
def jd_text(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).select("doc_id", jobs.to_text(F.col("job")).alias("text"))


@query("job_dedup", "WITH j AS (SELECT event_id AS pos, CASE WHEN CAST(props->>'$.k' AS INTEGER) % 3 = 0 THEN '' ELSE 'u' || (props->>'$.k') END AS url FROM events) SELECT pos, url FROM j QUALIFY url = '' OR row_number() OVER (PARTITION BY url ORDER BY pos) = 1")
def job_dedup(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return dedup.jobs(spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("pos"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("u"), k.cast("string"))).alias("url")))


@query("job_listing", """SELECT CASE doc_id % 2 WHEN 0 THEN 'boss' ELSE 'liepin' END AS platform, doc_id, CAST(0 AS INTEGER) AS pos, CASE doc_id % 2 WHEN 0 THEN 'T' ELSE '' END AS title,
    CASE doc_id % 2 WHEN 0 THEN 'https://b.example/j/' || doc_id ELSE 'https://b.example/liepin.com/job/' || doc_id || '.shtml' END AS url FROM documents""")
def job_listing(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    even = F.col("doc_id") % 2 == 0
    rows = spark.read.parquet(f"{d}/documents.parquet").select(
        F.when(even, "boss").otherwise("liepin").alias("platform"), F.lit("https://b.example").alias("base"),
        F.when(even, F.concat(F.lit('[{"title": "T", "url": "/j/'), i, F.lit('"}]'))).otherwise("none").alias("response"), F.concat(F.lit("see liepin.com/job/"), i, F.lit(".shtml and LIEPIN.com/job/"), F.lit("x")).alias("text"),
    )
    out = jobs.listed(rows)
    return out.select("platform", F.regexp_extract("url", r"/(\d+)", 1).cast("bigint").alias("doc_id"), "pos", "title", "url")


@query("json_longest_text", "SELECT doc_id, CASE WHEN length(text) > 50 THEN text END AS text FROM documents")
def json_longest_text(spark: SparkSession, d: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("lang"), F.struct(F.array(F.struct("text")).alias("a")).alias("deep"), F.array("text", "text").alias("ignored")))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", json_dig.longest_text(body).alias("text"))


_BITS = " + ".join(f"CASE WHEN embedding[{i + 1}] < embedding[{i + 2}] THEN {1 << (55 - k)} ELSE 0 END" for k, i in enumerate(i for i in range(63) if i % 8 != 7))


@query("frame_dhash", f"SELECT vec_id, CAST({_BITS} AS BIGINT) AS hash FROM embeddings")
def frame_dhash(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", frames.dhash(F.col("embedding")).alias("hash"))


@query("frame_dedup", f"""WITH h AS (SELECT label AS key, vec_id AS pos, CAST({_BITS} AS BIGINT) AS hash FROM embeddings), l AS (SELECT *, lag(hash) OVER (PARTITION BY key ORDER BY pos) AS b FROM h)
    SELECT key, pos, hash FROM l WHERE b IS NULL OR bit_count(xor(hash, b)) > 25""")
def frame_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("key"), F.col("vec_id").alias("pos"), frames.dhash(F.col("embedding")).alias("hash"))
    return frames.drop_repeats(rows, 25)


@query("image_dedup")
def image_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").cast("bigint").alias("key"), F.col("vec_id").alias("pos"), F.transform("embedding", lambda x: x * 10).alias("pixels"))
    return frames.drop_similar(rows, near=3.0, share=0.9)


@query("text_dedup_consecutive", "WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, event_id, event_type FROM l WHERE b IS NULL OR b <> event_type")
def text_dedup_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return dedup.consecutive(spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("text_dedup_set", "WITH f AS (SELECT user_id, props, min(event_id) AS seen FROM events WHERE length(props) > 3 GROUP BY 1, 2), j AS (SELECT user_id, string_agg(props, chr(10) ORDER BY seen) AS text FROM f GROUP BY 1) SELECT user_id, text FROM j WHERE length(text) > 100")
def text_dedup_set(spark: SparkSession, d: str) -> DataFrame:
    return dedup.drawn_texts(spark.read.parquet(f"{d}/events.parquet"), "user_id", "event_id", "props")


@query("substring_eliminate", """WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN substr(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 3, 20) ELSE text END AS text FROM conversations)
    SELECT conv_id, turn, text FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.conv_id = a.conv_id AND length(b.text) > length(a.text) AND contains(b.text, a.text))""")
def substring_eliminate(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.substring(before, 3, 20)).otherwise(F.col("text")).alias("text"))
    return dedup.drop_contained(rows, "conv_id", "text")


@query("rate_schedule", """WITH o AS (SELECT event_type AS domain, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS a, row_number() OVER (PARTITION BY event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS i FROM events)
    SELECT domain, event_id, max(a - i * 3600) OVER (PARTITION BY domain ORDER BY i) + i * 3600 AS slot FROM o""")
def rate_schedule(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("domain"), "event_id", F.unix_timestamp(F.date_trunc("second", "ts")).alias("a"))
    return schedule.slots(rows, 3600, at="a", tie="event_id").select("domain", "event_id", F.col("slot").cast("bigint").alias("slot"))


@query("batch_parse", "WITH l AS (SELECT conv_id, turn, trim(CASE turn % 4 WHEN 0 THEN '  ' || role || ' ' WHEN 1 THEN '# ' || role WHEN 2 THEN 'https://x.example/' || turn ELSE '   ' END) AS item FROM conversations) SELECT conv_id, turn, item, starts_with(item, 'https://') AS is_url FROM l WHERE item <> '' AND NOT starts_with(item, '#')")
def batch_parse(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    line = F.when(t % 4 == 0, F.concat(F.lit("  "), "role", F.lit(" "))).when(t % 4 == 1, F.concat(F.lit("# "), "role")).when(t % 4 == 2, F.concat(F.lit("https://x.example/"), t.cast("string"))).otherwise("   ")
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", line.alias("value"))
    return batch.items(rows)


@query("result_render", """WITH r AS (SELECT *, CASE WHEN turn % 3 = 0 THEN NULL ELSE 'https://r.example/' || turn END AS url, turn / 8e0 AS score FROM conversations)
    SELECT conv_id AS key, string_agg(coalesce(text, ''), chr(10) || chr(10) || '=====' || chr(10) || chr(10) ORDER BY turn) AS plain,
        '# Batch results' || chr(10) || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || '- Score: ' || format('{:.3f}', score) || chr(10) || '- URL: ' || coalesce(url, '') || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS md FROM r GROUP BY 1""")
def result_render(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    url = F.when(t % 3 != 0, F.concat(F.lit("https://r.example/"), t.cast("string")))
    rows = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("key"), t.alias("pos"), F.col("role").alias("input"), "text", url.alias("url"), (t / 8).alias("score"))
    return batch.document(rows, "md").withColumnRenamed("document", "md").join(batch.document(rows).withColumnRenamed("document", "plain"), "key")


@query("result_single", """WITH r AS (SELECT *, turn % 2 = 0 AS good FROM conversations)
    SELECT conv_id, turn, '# Extraction result' || chr(10) || chr(10) || '- Status: ' || CASE WHEN good THEN 'success' ELSE 'best-effort' END || chr(10) || '- Score: ' || format('{:.3f}', turn / 16e0) || chr(10) || '- URL: ' || chr(10) || '- Stage: ' || CASE WHEN good THEN role ELSE 'none' END || chr(10) || '- Time: ' || turn || ' ms' || chr(10) || chr(10) || '## Content' || chr(10) || chr(10) || text || chr(10) AS md,
        '{"success":' || good || ',"score":null,"url":null,"text":null,"winning_stage":' || CASE WHEN good THEN '"' || role || '"' ELSE 'null' END || ',"stages_attempted":' || turn || ',"stages_succeeded":null,"total_time_ms":null,"search_candidates_total":null,"search_candidates_scanned":null,"validation":null,"extraction_chain":null}' AS json FROM r""")
def result_single(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    rows = spark.read.parquet(f"{d}/conversations.parquet").withColumn("success", t % 2 == 0).withColumn("winning_stage", F.when(F.col("success"), F.col("role")))
    md = batch.results(rows.withColumns({"score": t / 16, "total_time_ms": t})).select("conv_id", "turn", batch.result_markdown().alias("md"))
    json = batch.results(rows.withColumn("stages_attempted", t).drop("text")).select("conv_id", "turn", batch.result_json().alias("json"))
    return md.join(json, ["conv_id", "turn"])


@query("domain_extract", f"""WITH {_with("urls")} SELECT id, coalesce(nullif(lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/:?#]+)', 1)), ''), url) AS domain, coalesce(nullif(regexp_extract(url, 'https?://(?:www\\.)?([^/]+)', 1), ''), substr(url, 1, 40)) AS source_name,
    regexp_replace(coalesce(nullif(lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/:?#]+)', 1)), ''), url), '[^\\p{{L}}\\p{{N}}._-]', '_', 'g') AS profile, coalesce(regexp_matches(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/:?#]+)', 1), '(?i){rules.STREAMING_HOSTS}'), false) AS streaming FROM urls""")
def domain_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = batch.with_domain(fixtures.urls(spark, d))
    return rows.select("id", "domain", "source_name", T.profile_name("url").alias("profile"), C.is_streaming_host("url").alias("streaming"))


@query("llm_trim")
def llm_trim(spark: SparkSession, d: str) -> DataFrame:
    """All texts. The rule is a running choice of lines, which SQL hasn't; a test compares with it written plainly."""
    return fixtures.documents(spark, d).select("doc_id", jobs.trim("text").alias("short"))


#: answers of four services with @, the page, in some addresses
_BODY = '{"web": {"results": [{"url": "a@"}, {"url": "b"}, {"url": "a@"}]}, "results": [{"url": "c@"}, {"url": null}, {"url": "c@"}, {"url": "c"}], "RelatedTopics": [{"FirstURL": "d@"}, {"Topics": []}], "Results": [{"FirstURL": "d@"}, {"FirstURL": "e"}]}'
_LITE = """<a class="result-link" href="//ad">x</a><a class='result-link' rel=n href='https://r/@'>y</a><a href="/l?uddg=https%3A%2F%2Fz%2F@&amp;k=1"><a href="/l?uddg=https%3A%2F%2Fz%2F">"""
_FIRST = lambda l, most: f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_filter({l}, lambda x: x IS NOT NULL AND x <> ''), lambda x: [x])), lambda s, x: CASE WHEN list_contains(s, x[1]) THEN s ELSE list_concat(s, x) END)[1:{most}]"
_URLS_AT = lambda path: f"CAST(json_extract_string(body, '{path}') AS VARCHAR[])"


@query("serp_parse", f"""WITH b AS (SELECT page_id, replace(CASE WHEN page_id % 5 = 4 THEN '{{}}' ELSE {_q(_BODY)} END, '@', CAST(page_id % 7 AS VARCHAR)) AS body, replace(replace({_q(_LITE)}, '@', CAST(page_id AS VARCHAR)), CASE WHEN page_id % 2 = 1 THEN 'class=' || chr(39) || 'result-link' || chr(39) ELSE '@' END, '') || CASE WHEN page_id % 11 = 10 THEN '<p class="anomaly-modal">' ELSE '' END AS lite FROM pages),
    l AS (SELECT *, list_filter(regexp_extract_all(lite, 'class=["'']result-link["''][^>]*href=["'']([^"'']+)["'']', 1), lambda x: NOT starts_with(x, '//')) AS direct, list_transform(regexp_extract_all(lite, 'uddg=([^&"'']+)', 1), lambda x: url_decode(x)) AS sent FROM b),
    u AS (SELECT page_id, {_FIRST(_URLS_AT('$.web.results[*].url'), 20)} AS brave, {_FIRST(_URLS_AT('$.results[*].url'), 20)} AS searxng, {_FIRST(_URLS_AT('$.results[*].url'), 10)} AS exa,
        {_FIRST(f"list_concat({_URLS_AT('$.RelatedTopics[*].FirstURL')}, {_URLS_AT('$.Results[*].FirstURL')})", 20)} AS instant, CASE WHEN contains(lite, 'anomaly-modal') THEN [] ELSE {_FIRST("CASE WHEN len(direct) > 0 THEN direct ELSE sent END", 20)} END AS lite FROM l)
    SELECT page_id, array_to_string(brave, ',') AS brave, array_to_string(exa, ',') AS exa, array_to_string(CASE WHEN len(instant) > 0 AND page_id % 3 = 0 THEN instant ELSE searxng END, ',') AS searxng, array_to_string(instant, ',') AS instant, array_to_string(lite, ',') AS lite FROM u""")
def serp_parse(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    body = F.replace(F.when(i % 5 == 4, "{}").otherwise(_BODY), F.lit("@"), (i % 7).cast("string"))
    lite = F.replace(F.lit(_LITE), F.lit("@"), i.cast("string"))
    lite = F.concat(F.when(i % 2 == 1, F.replace(lite, F.lit("class='result-link'"), F.lit(""))).otherwise(lite), F.when(i % 11 == 10, '<p class="anomaly-modal">').otherwise(""))
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", body.alias("body"), lite.alias("lite"))
    joined = lambda c: F.array_join(c, ",")
    chosen = serp.first_backend(serp.duckduckgo_instant_urls(F.when(i % 3 == 0, F.col("body")).otherwise("{}")), serp.searxng_urls("body"))
    return rows.select("page_id", joined(serp.brave_urls("body")).alias("brave"), joined(serp.exa_urls("body")).alias("exa"), joined(chosen).alias("searxng"), joined(serp.duckduckgo_instant_urls("body")).alias("instant"), joined(serp.duckduckgo_lite_urls("lite")).alias("lite"))


_ASCII = "regexp_replace(text, '[^\\x01-\\x7f]', '', 'g')"


@query("decode_bytes", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '中文' || {_ASCII} ELSE '中文' || {_ASCII} END AS text FROM documents")
def decode_bytes(spark: SparkSession, d: str) -> DataFrame:
    """UTF-8, GBK without a hint, and Big5 with one."""
    i = F.col("doc_id")
    plain = F.encode(F.regexp_replace("text", r"[^\x{1}-\x{7f}]", ""), "UTF-8")
    body = F.when(i % 3 == 0, F.encode("text", "UTF-8")).when(i % 3 == 1, F.concat(F.unhex(F.lit("D6D0CEC4")), plain)).otherwise(F.concat(F.unhex(F.lit("A4A4A4E5")), plain))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.decoded(body, F.when(i % 3 == 2, "big5").when(i % 3 == 1, "no-such-encoding")).alias("text"))


@query("response_bodies", """WITH r AS (SELECT doc_id, (['https://h.example/api/x', 'https://h.example/page', 'https://h.example/api/y'])[CAST(doc_id % 3 AS INTEGER) + 1] AS url, (['application/json', 'text/html; charset=utf-8', 'image/png'])[CAST(doc_id // 3 % 3 AS INTEGER) + 1] AS kind, text FROM documents),
    b AS (SELECT *, CASE WHEN contains(kind, 'json') THEN CAST(json_object('code', 0, 'data', json_object('t', text)) AS VARCHAR) ELSE text END AS body FROM r)
    SELECT doc_id, CASE WHEN contains(kind, 'json') THEN CASE WHEN length(text) > 50 THEN text END WHEN contains(kind, 'html') AND contains(url, '/api/') AND length(body) > 200 THEN body END AS api,
        CASE WHEN contains(kind, 'json') THEN CASE WHEN length(body) > 200 THEN substr(body, 1, 5000) END WHEN contains(kind, 'html') AND length(body) > 500 THEN substr(body, 1, 10000) END AS kept FROM b""")
def response_bodies(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int") + 1)
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", pick(["https://h.example/api/x", "https://h.example/page", "https://h.example/api/y"], i).alias("url"), pick(["application/json", "text/html; charset=utf-8", "image/png"], F.floor(i / 3)).alias("kind"))
    rows = rows.withColumn("body", F.when(F.col("kind").contains("json"), F.to_json(F.struct(F.lit(0).alias("code"), F.struct(F.col("text").alias("t")).alias("data")))).otherwise(F.col("text")))
    return rows.select("doc_id", T.api_text("url", "kind", F.encode("body", "UTF-8")).alias("api"), T.captured_body("kind", "body").alias("kept"))


@query("multi_extract", """WITH r AS (SELECT doc_id // 5 AS query_id, doc_id % 5 AS round, 'u' || (doc_id % 4 // 2) AS url, CASE WHEN doc_id % 7 = 3 THEN '' ELSE text END AS text, (doc_id % 10) / 1e1 AS score FROM documents WHERE doc_id % 5 < 3),
    e AS (SELECT *, coalesce(max(CAST(score < 3e-1 AS INTEGER)) OVER (PARTITION BY query_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM r)
    SELECT query_id, round, url, text, score FROM e WHERE ended = 0 AND text <> '' QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY round) = 1""")
def multi_extract(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.floor(i / 5).alias("query_id"), (i % 5).alias("round"), F.concat(F.lit("u"), F.floor(i % 4 / 2).cast("string")).alias("url"), F.when(i % 7 == 3, "").otherwise(F.col("text")).alias("text"), (i % 10 / 10).alias("score"))
    return dedup.best_of_many(rows, 3, 0.3)


@query("requests_in_flight", """WITH e AS (SELECT event_type AS domain, event_id AS pos, epoch_us(ts) AS s, epoch_us(ts) + event_id % 600 * 1000000 AS f FROM events),
    v AS (SELECT domain, pos, s AS t, 1 AS d FROM e UNION ALL SELECT domain, pos, f, -1 FROM e), r AS (SELECT *, sum(d) OVER (PARTITION BY domain ORDER BY t, d, pos ROWS UNBOUNDED PRECEDING) AS n FROM v)
    SELECT domain, pos, CAST(n AS BIGINT) AS in_flight, n <= 4 AS ok FROM r WHERE d = 1""")
def requests_in_flight(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("domain"), F.col("event_id").alias("pos"), at.alias("start"), (at + F.col("event_id") % 600 * 1000000).alias("finish"))
    return limiter.admitted(rows, 4).select("domain", "pos", "in_flight", "ok")
