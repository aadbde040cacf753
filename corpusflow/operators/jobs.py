"""Job postings: search addresses, parsing of model answers, and texts cut for models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import rules, rx
from corpusflow.functions.text import col
from corpusflow.operators import dedup

_TEXTS = ("title", "company", "salary", "location", "experience", "education")
_LISTS = ("responsibilities", "requirements", "nice_to_have", "benefits", "tech_stack")
FIELDS = ", ".join([f"{f} string" for f in _TEXTS] + [f"{f} array<string>" for f in _LISTS])
_MENU = "APP 举报 公司 关于 反馈 小程序 帮助 校园 注册 登录 联系 职位 资讯 退出 首页"
_NOISE = [r"^\s*$", f"^({'|'.join(_MENU.split())})" + ".{0,30}$"]
_WANTED = "加分 学历 技能 技术栈 福利 经验 职责 薪资 要求".split()


def search_urls(wanted: DataFrame) -> DataFrame:
    """(platform, keyword, city, page) with url, the keyword as it is. A city that a platform has no code for stands for itself; unknown
    platforms have no row."""
    spark = wanted.sparkSession
    sites = spark.createDataFrame([(p, t) for p, (t, _, _) in rules.PLATFORMS.items()], "platform string, template string")
    codes = spark.createDataFrame([(p, c, k) for p, (_, _, m) in rules.PLATFORMS.items() for c, k in m.items()], "platform string, city string, code string")
    rows = wanted.join(F.broadcast(sites), "platform").join(F.broadcast(codes), ["platform", "city"], "left")
    url = F.col("template")
    for name, value in (("keyword", F.col("keyword")), ("city_code", F.coalesce("code", "city")), ("city", F.col("city")), ("page", F.col("page").cast("string"))):
        url = F.replace(url, F.lit(f"{{{name}}}"), value)
    return rows.select("platform", "keyword", "city", "page", url.alias("url"))


def without_fences(text: Column | str) -> Column:
    t = rx.strip(col(text))
    inner = F.regexp_replace(F.regexp_replace(t, r"\A```[\p{L}\p{N}_]*\n?", ""), r"\n?```\z", "")
    return rx.strip(F.when(t.startswith("```"), inner).otherwise(t))


def parse(response: Column | str, text: Column | str, url: Column | str) -> Column:
    """A posting from a model's answer: JSON, else the first braces in it; without either, the text's first line as the
    title. Texts of under 50 characters give an empty posting. Missing fields are '' or []."""
    body = without_fences(response)
    # a corrupt record parses to nulls in every field; the title tells
    whole, part = F.from_json(body, FIELDS), F.from_json(F.regexp_extract(body, r"(?s)\{.*\}", 0), FIELDS)
    some = lambda p: F.coalesce(*[p[f].cast("string") if f in _TEXTS else F.array_join(p[f], "") for f in (*_TEXTS, *_LISTS)]).isNotNull()
    parsed = F.when(some(whole), whole).otherwise(part)
    enough = F.length(rx.strip(col(text))) >= 50
    first = F.substring(F.split(rx.strip(col(text)), "\n")[0], 1, 80)
    title = F.when(col(response).isNull(), F.when(enough, first)).otherwise(F.when(enough, parsed["title"]))
    fields = [F.coalesce(title, F.lit("")).alias("title")]
    fields += [F.coalesce(F.when(enough, parsed[f]), F.lit("")).alias(f) for f in _TEXTS[1:]]
    fields += [F.coalesce(F.when(enough, parsed[f]), F.array().cast("array<string>")).alias(f) for f in _LISTS]
    return F.struct(*fields, col(url).alias("source_url"), F.length(col(text)).alias("raw_length"))


def to_text(job: Column) -> Column:
    """A posting in labelled lines; empty fields are left out."""
    line = lambda f, label: F.when(job[f] != "", F.concat(F.lit(label), job[f]))
    block = lambda f, label: F.when(F.size(job[f]) > 0, F.concat(F.lit(f"\n{label}：\n  "), F.array_join(job[f], "\n  ")))
    return F.concat_ws(
        "\n", F.when(job["title"] != "", F.concat(F.lit("【"), job["title"], F.lit("】"))),
        *[line(f, f"{label}：") for f, label in zip(_TEXTS[1:], "公司 薪资 地点 经验 学历".split())],
        block("requirements", "要求"), block("responsibilities", "职责"), block("nice_to_have", "加分"),
        F.when(F.size(job["tech_stack"]) > 0, F.concat(F.lit("\n技术栈："), F.array_join(job["tech_stack"], ", "))),
    )


def trim(text: Column | str, most: int = 8000) -> Column:
    """Long texts lose lines of navigation; if still long, two thirds stay and, of the rest, the lines that speak of
    the posting, up to the first that doesn't fit."""
    t = col(text)
    noise = lambda x: F.rlike(rx.strip(x), F.lit("|".join(rx.java(p) for p in _NOISE)))
    lines = F.filter(F.split(t, "\n", -1), lambda x: ~noise(x))
    kept = F.array_join(lines, "\n")
    head = int(most * 0.67)
    tail = F.filter(F.split(F.substr(kept, F.lit(head + 1)), "\n", -1), lambda x: F.rlike(x, F.lit("|".join(_WANTED))))
    start = F.struct(F.lit("").alias("t"), F.lit(False).alias("full"))

    def step(s: Column, x: Column) -> Column:
        fits = ~s["full"] & (F.length(s["t"]) + F.length(x) + 1 <= most - head)
        return F.struct(F.when(fits, F.concat(s["t"], x, F.lit("\n"))).otherwise(s["t"]).alias("t"), (s["full"] | ~fits).alias("full"))

    short = F.concat(F.substring(kept, 1, head), F.lit("\n"), F.aggregate(tail, start, step, lambda s: s["t"]))
    return F.when(F.length(t) <= most, t).when(F.length(kept) <= most, kept).otherwise(short)


def absolute(url: Column | str, platform: Column | str) -> Column:
    """A posting's address on its platform; unknown platforms leave it as it is, null becomes ''."""
    u = F.coalesce(col(url), F.lit(""))
    base = F.try_element_at(F.create_map(*[F.lit(x) for pair in rules.PLATFORM_SITES.items() for x in pair]), col(platform))
    full = F.when(u.startswith("/"), F.concat(base, u)).otherwise(F.concat(base, F.lit("/"), u))
    return F.when((u == "") | u.startswith("http") | base.isNull(), u).otherwise(full)


def listed(answers: DataFrame) -> DataFrame:
    """(platform, base, response, text) → (platform, pos, title, url): the jobs of a JSON array, root-relative
    addresses resolved; from answers that aren't one, the detail addresses in the text, by first sight, at most 30."""
    array = F.from_json(without_fences("response"), "array<struct<title: string, url: string>>")
    pattern = F.create_map(*[x for p, (_, d, _) in rules.PLATFORMS.items() for x in (F.lit(p), F.lit(f"(?i){d}"))])
    rows = answers.withColumn("jobs", array).withColumn("p", F.try_element_at(pattern, F.col("platform")))
    good = rows.where("jobs is not null").select("platform", "base", F.posexplode("jobs").alias("pos", "j"))
    url = F.when(F.col("j.url").startswith("/"), F.concat(F.col("base"), F.col("j.url"))).otherwise(F.coalesce("j.url", F.lit("")))
    one = good.select("platform", "pos", F.coalesce("j.title", F.lit("")).alias("title"), url.alias("url"))
    found = F.slice(F.array_distinct(F.regexp_extract_all("text", F.col("p"), F.lit(0))), 1, 30)
    bad = rows.where("jobs is null and p is not null").select("platform", "base", F.posexplode(found).alias("pos", "u"))
    return one.unionByName(bad.select("platform", "pos", F.lit("").alias("title"), F.concat("base", F.lit("/"), "u").alias("url")))


def discovered(pages: DataFrame) -> DataFrame:
    """(platform, page, text, jobs) → (platform, page, pos, title, url): a platform's pages up to the first of under
    200 characters or without jobs; jobs with an address once."""
    from pyspark.sql import Window

    stop = ((F.length("text") < 200) | (F.size("jobs") == 0)).cast("int")
    upto = Window.partitionBy("platform").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    rows = pages.withColumn("ended", F.max(stop).over(upto)).where("ended = 0").select("platform", "page", F.posexplode("jobs").alias("i", "j"))
    return dedup.jobs(rows.select("platform", "page", F.struct("platform", "page", "i").alias("pos"), F.col("j.title").alias("title"), F.col("j.url").alias("url")))
