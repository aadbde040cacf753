"""Literal decorations that make plain test tables touch every rule, and relations made of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CJK = "这是一段很长的中文正文内容，"
#: prefix and suffix of a text by doc_id % 24
TEXTS: list[tuple[str, str]] = [
    ("", ""),
    ("登录 注册 copyright cookie 隐私 privacy ", ""),
    ("Login ", ""),
    ("加载中 loading ", ""),
    ("第一章 开端\n" + _CJK * 60, ""),
    ("第12章 远行\n\n" + "他说道：“走吧。”" * 40, "\n第13章 归来 \n"),
    ("\n".join(f"第{k}章 标题{k}" for k in range(1, 25)) + "\n章节目录 作者：某人\n", ""),
    ("\n".join(f"第{c}回 {c}" for c in "一二三四五六七八") + "\n" + "\n".join("短" for _ in range(12)) + "\n", ""),
    ("发布于 2024-03-15 作者 原创\n", "\n点赞 收藏"),
    ("```\nnpm install x\n```\n示例 参数 function class\n", ""),
    ("岗位 薪资 20k 学历 要求 福利 HR\n", ""),
    ("2023年5月6日 记者 报道 来源：某报\n", ""),
    ("\n\n".join("Paragraph number one. It has words." for _ in range(14)) + "\n\n", ""),
    ("- item one\n- item two\n", ""),
    ("a | b | c\n", ""),
    ("\ue000\ue001 hidden ", ""),
    ("\ufffd" * 80 + " broken ", ""),
    ("\U0001f600" * 70 + " smile ", ""),
    ("\u00a0 \u3000 wide spaces \u00a0\u3000", "\u3000\u00a0 "),
    ("carriage\r\nreturn\rline- \nend-\nword\n\n\n\n\n", ""),
    ("", " " * 4000 + "\n" * 9),
    ("三体 刘慈欣 AI mail AI. ", " 三体"),
    ("Title: something\nURL: x\n\nBody of it. ", ""),
    ("加入书架 tail\nkeep 下载 gone\n", ""),
]
#: an address by id % 24
URLS = [
    "https://www.biquge.com/book/123.html", "https://example.com/login", "https://example.com/search?q=test", "https://shop.com/cart", "https://blog.example.com/how-to-code",
    "https://example.com/author/jane", "https://example.com/tag/a/feed/", "https://example.com/tag/a/feed/about", "https://example.com/page/12", "https://example.com/page/2",
    "https://www.biquge.com/book/index/", "https://docs.python.org/3/library/re.html", "https://www.zhipin.com/web/x", "https://news.sina.com.cn/c/2020", "https://example.com/cartoon",
    "mailto:a@b.c", "https://example.com/a.PNG?x=1", "https://example.com/2024/05/", "#top", "https://kdocs.cn/l/abc", "https://user:pw@Example.COM:80/x_y", "https://example.com/article/7", "https://example.com/FAQ", "https://m.qidian.com/chapter/9_12.html",
]
#: markup put before a page by page_id % 12
HTML = [
    '<div class="g-recaptcha" data-sitekey="k1"></div>', "<div class='h-captcha' data-sitekey='k2'></div>", '<div class="h-captcha"></div>', '<div class="cf-turnstile"></div>', "<p>Checking your browser</p>", "<p>请输入验证码</p><p>are you a human</p>",
    '<base href="https://base.example/dir/"><a href="x/../9.html">第9章 a</a><a href="100.html">第100章 b</a>', '<a class="c" href="https://abs.example/2">Ch 2</a><a href="//proto.example/3">Ep.3</a><a href="javascript:void(0)">第1章</a>',
    '<a href="/12"><b>12</b></a><a href="/12">第12章</a><a href="?p=4">4. four</a>', "&amp;lt;tag&amp;gt; &quot;q&quot; &#39;s&#39; &nbsp;&nbsp;x", "<svg><path/></svg><noscript>no</noscript>\n\n\n\n\n<iframe src=x></iframe>", '<a href="/n2">下一页</a><a href="/c2">下一章</a>',
]


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int") + 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, text): every document with its decoration."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", "source", F.concat(_pick([p for p, _ in TEXTS], F.col("doc_id")), "text", _pick([s for _, s in TEXTS], F.col("doc_id"))).alias("text"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, url): every page's address and, by its id, one of the decorated."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(F.explode(F.array(F.struct((F.col("page_id") * 2).alias("id"), "url"), F.struct((F.col("page_id") * 2 + 1).alias("id"), _pick(URLS, F.col("page_id")).alias("url")))).alias("r")).select("r.*")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", "url", F.concat(_pick(HTML, F.col("page_id")), "html").alias("html"))


def serp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, backend, backend_pos, rank, url) of events: users are queries, kinds are backends, rank by time."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = (F.get_json_object("props", "$.k").cast("int")).alias("k")
    rows = e.select((F.col("user_id") % 50).alias("query_id"), F.col("event_type").alias("backend"), "ts", "event_id", k)
    rank = F.row_number().over(Window.partitionBy("query_id", "backend").orderBy("ts", "event_id")) - 1
    url = F.when(F.col("k") % 4 == 0, _pick(URLS, F.col("k"))).otherwise(F.concat(F.lit("https://site.example/"), F.col("k").cast("string")))
    pos = F.ascii("backend")
    return rows.select("query_id", "backend", pos.alias("backend_pos"), rank.alias("rank"), url.alias("url"))


def stage_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, url_rank, url, stage_index, stage_name, text, preview): documents 21 to a query, seven stages to an
    address, whose preview is its first document's beginning."""
    from pyspark.sql import Window

    i = F.col("doc_id")
    first = F.first("text").over(Window.partitionBy("url").orderBy("doc_id"))
    rows = documents(spark, sf_dir).withColumn("url", F.concat(F.lit("https://u.example/"), F.floor(i / 7).cast("string")))
    return rows.select(
        F.floor(i / 21).alias("query_id"), (F.floor(i % 21 / 7)).cast("int").alias("url_rank"), "url", (i % 7).cast("int").alias("stage_index"),
        F.concat(F.lit("stage"), (i % 7).cast("string")).alias("stage_name"), "text", F.substring(first, 1, 2000).alias("preview"),
    )


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


#: The same relations for the other engine.
SQL = {
    "docs": f"SELECT doc_id, source, ({_list([p for p, _ in TEXTS])})[CAST(doc_id % 24 AS INTEGER) + 1] || text || ({_list([s for _, s in TEXTS])})[CAST(doc_id % 24 AS INTEGER) + 1] AS text FROM documents",
    "urls": f"SELECT page_id * 2 AS id, url FROM pages UNION ALL SELECT page_id * 2 + 1, ({_list(URLS)})[CAST(page_id % 24 AS INTEGER) + 1] FROM pages",
    "html": f"SELECT page_id, url, ({_list(HTML)})[CAST(page_id % 12 AS INTEGER) + 1] || html AS html FROM pages",
    "serp": f"""SELECT query_id, backend, ascii(backend) AS backend_pos, row_number() OVER (PARTITION BY query_id, backend ORDER BY ts, event_id) - 1 AS rank,
        CASE WHEN k % 4 = 0 THEN ({_list(URLS)})[k % 24 + 1] ELSE 'https://site.example/' || k END AS url
        FROM (SELECT user_id % 50 AS query_id, event_type AS backend, ts, event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events)""",
    "stages": """SELECT doc_id // 21 AS query_id, CAST(doc_id % 21 // 7 AS INTEGER) AS url_rank, 'https://u.example/' || (doc_id // 7) AS url, CAST(doc_id % 7 AS INTEGER) AS stage_index, 'stage' || (doc_id % 7) AS stage_name, text,
        substr(first_value(text) OVER (PARTITION BY doc_id // 7 ORDER BY doc_id), 1, 2000) AS preview FROM docs""",
}
