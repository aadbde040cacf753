"""Hand-computed values."""

import difflib
import json

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import classify as C
from corpusflow.functions import json_dig
from corpusflow.functions import text as T
from corpusflow.operators import align, dedup, frames, jobs, links, schedule, select, serp
from corpusflow.plans import pipeline
from corpusflow.sources import batch


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first().r


LONG = "这是一段很长的正文内容"
SCORES = [
    ("", 0.0), ("短文本", 0.0), (None, 0.0), ("a" * 5000, 0.4001), ("第一章\n" + (LONG + "。") * 500, 0.5512), ("第一章 开端\n" + (LONG + "，") * 500, 0.4765),
    ("登录 注册 copyright cookie 隐私 privacy " + "正文" * 200, 0.0), ("useful local content " * 20, 0.1383), ("\n".join(["三体 第一章 科学边界", "正文内容关于三体问题。" * 100]), 0.3257),
]


@pytest.mark.parametrize("text, score", SCORES)
def test_completeness(spark, text, score):
    assert one(spark, text, T.completeness) == pytest.approx(score, abs=1e-4)


def test_quality(spark):
    novel = one(spark, "第一章 开端\n" + "这是一段很长的中文正文内容，" * 300, C.score_content)
    assert (novel.quality, novel.type, novel.type_confidence) == (pytest.approx(0.35), "novel_chapter", pytest.approx(0.375))
    text = "\n".join(["三体 第一章 科学边界", "正文内容关于三体问题。" * 100])
    assert one(spark, text, C.score_content).quality == pytest.approx(0.4)
    found = one(spark, text, lambda c: C.score_content(c, "三体"))
    assert found.quality == pytest.approx(0.65) and found.keyword_density == pytest.approx(9.0827, abs=1e-4) and found.keyword_head_bonus
    assert one(spark, "短文本", C.score_content).type == "empty"


URLS = [
    ("https://www.biquge.com/book/123.html", True, "novel_chapter"), ("https://example.com/login", False, "noise_high"), ("https://example.com/search?q=test", False, "noise_high"), ("https://shop.com/cart", False, "noise_high"),
    ("https://blog.example.com/how-to-code", True, "blog_article"), ("https://example.com/author/jane", False, "noise_high"), ("https://example.com/tag/a/feed/", True, "uncertain"), ("https://example.com/tag/a/feed/about", False, "noise_mid_multi"), ("https://example.com/page/12", True, "unknown"),
]


@pytest.mark.parametrize("url, good, kind", URLS)
def test_urls(spark, url, good, kind):
    verdict = one(spark, url, C.classify_url)
    assert (verdict.is_content, verdict.type) == (good, kind)


def test_rewriting(spark):
    assert one(spark, "<html><script>var x=1;</script><body><p>Hello<p>World</body></html>", T.html_to_text) == "Hello World"
    assert one(spark, "&amp;lt;", T.html_to_text) == "<"
    assert one(spark, "Title: x\nURL: y\n\nBody", T.strip_reader_header) == "Body"
    assert one(spark, "Title: x\n", T.strip_reader_header) == ""
    assert one(spark, "Title: x\nno blank", T.strip_reader_header) == "Title: x\nno blank"
    assert one(spark, "a-\nb    c\r\nd", T.clean_ocr) == "ab  c\nd"
    assert one(spark, "http://u:p@h.example:80/x", T.mask_proxy) == "http://***:***@h.example:80/x"
    assert [one(spark, n, T.cn_number) for n in "十 三十五 一百二十三 一百零五 二千三百 零 两百".split()] == [10, 35, 123, 105, 2300, 1, 1]
    assert one(spark, "第123456789章", T.sort_key) == "123456789" and one(spark, "第7章", T.sort_key) == "00000007"
    assert one(spark, ("�" * 2 + "Hello" + "\0" * 2) * 20, T.looks_garbled) and not one(spark, "Hello World", T.looks_garbled)
    pair = spark.createDataFrame([("alpha beta gamma " * 100 + "tail", "alpha beta gamma " * 100)], "a string, b string")
    assert pair.select(T.consistency("a", "b")).first()[0] == 1.0


def test_validate(spark):
    good = one(spark, "第一章 三体\n" + "这是一段关于三体问题的讨论。" * 300, lambda c: C.validate(c, None, "三体"))
    assert good.passes and good.completeness == pytest.approx(0.5046, abs=1e-4)
    assert good.passed == 3  # completeness, keyword and curve
    bad = one(spark, "", lambda c: C.validate(c, None, "test"))
    assert bad.passed == 0 and bad.checks == ["completeness", "keyword", "too_short"]
    other = one(spark, "第一章 三体\n" + "这是一段关于三体问题的讨论。" * 300, lambda c: C.validate(c, F.lit("nothing in common at all " * 20), "三体"))
    assert not other.passes and other.checks == ["inconsistent"] and other.consistency == 0.0
    same = one(spark, "第一章 三体\n" + "这是一段关于三体问题的讨论。" * 300, lambda c: C.validate(c, c, "三体"))
    assert same.passes and same.passed == 4
    assert not bad.passes and bad.failed == 3
    assert not one(spark, None, lambda c: C.validate(c)).passes


def test_best_effort(spark):
    rows = [(1, 0, "u", 0, "jina_reader", "useful local content " * 20)]
    got = select.chain(spark.createDataFrame(rows, "query_id long, url_rank int, url string, stage_index int, stage_name string, text string")).first()
    assert (got.success, got.result, got.winning_stage) == (False, "best_effort", "jina_reader")


def test_slots(spark):
    rows = spark.createDataFrame([("d", float(a), k) for k, a in enumerate((0, 1, 1, 9))], "domain string, arrival double, pos long")
    assert [r.slot for r in schedule.slots(rows, 2.0).orderBy("pos").collect()] == [0, 2, 4, 9]


def test_json_dig(spark):
    deep = '{"a": {"b": {"c": {"d": {"e": "%s"}}}}, "l": ["%s"], "code": "function(%s"}' % ("x" * 60, "y" * 90, "z" * 99)
    assert one(spark, deep, json_dig.longest_text) == "x" * 60
    assert one(spark, "not json", json_dig.longest_text) is None


def test_alignment(spark):
    base = ["abcdefghij" * 20, "klmnopqrst" * 20, "uvwxyz0123" * 20]
    rows = [("w", 0, k, "a", "", t) for k, t in enumerate(base)] + [("w", 1, 0, "b", "", base[1][5:]), ("w", 1, 1, "b", "", "!" * 150)]
    found = {tuple(r) for r in align.align(spark.createDataFrame(rows, "work_id string, source_idx int, ordinal int, source_name string, title string, text string")).collect()}
    assert found == {("w", 1, 0, 0), ("w", 2, 0, 1), ("w", 3, 0, 2), ("w", 2, 1, 0), ("w", 4, 1, 1)}
    a, b = "ab" * 100, "ba" * 60 + "c" * 80
    pair = spark.createDataFrame([(a, b)], "a string, b string").select(align.ratio(F.col("a"), F.col("b"))).first()[0]
    assert pair == difflib.SequenceMatcher(None, a, b).ratio()


def test_auto_clean(spark):
    tail = "see also: the other chapters"
    head = "\n============\n第1章\n============\n"
    text = head.join(f"part {k} {tail if k < 3 else ''}" for k in range(4))
    same = "part " + tail
    rows = spark.createDataFrame([(1, head.join([same, same, same, "other"])), (2, "plain")], "key long, text string")
    found = dict(map(tuple, align.auto_clean(rows).collect()))
    assert found[2] == "plain" and same not in found[1] and "other" in found[1] and tail in text


def test_links(spark):
    html = '<base href="https://b.example/d/"><a href="../9.html">第9章</a><a href="/x">第100章</a><a href="//h.example/y">Ch 2</a><a href="javascript:x">第1章</a><a href="/x">Ep 5</a><a href="q">no</a>'
    found = [tuple(r)[1:] for r in links.discover(spark.createDataFrame([(1, "https://p.example/", html)], "page_id long, url string, html string")).orderBy("rank").collect()]
    assert found == [(1, "Ch 2", "https://h.example/y"), (2, "第9章", "https://b.example/9.html"), (3, "第100章", "https://b.example/x")]


def test_frames(spark):
    rows = [(1, k, [float(v)] * 64) for k, v in enumerate((0, 1, 100, 101, 0))]
    found = frames.drop_similar(spark.createDataFrame(rows, "key long, pos long, pixels array<double>")).collect()
    assert sorted(r.pos for r in found) == [0, 2]
    assert one(spark, [2.0, 1.0, 3.0, 4.0], lambda c: frames.dhash(c, 2), "array<double>") == 1


def test_jobs(spark):
    assert one(spark, '```json\n{"title": "x"}\n```', jobs.without_fences) == '{"title": "x"}'
    long = "\n".join(["首页 导航"] * 10 + ["x" * 99] * 100 + ["要求 " + "y" * 50] * 60)
    kept = one(spark, long, jobs.trim)
    assert len(kept) <= 8001 and "首页" not in kept and kept.count("要求") > 10
    assert one(spark, "short", jobs.trim) == "short"
    pages = spark.createDataFrame([("p", k, "t" * n, [("a", "u1"), ("b", "")]) for k, n in enumerate((300, 300, 10, 300))], "platform string, page int, text string, jobs array<struct<title: string, url: string>>")
    assert sorted(r.url for r in jobs.discovered(pages).collect()) == ["", "", "u1"]


def test_serp(spark):
    rows = [(1, "b1", 0, 0, "u"), (1, "b1", 0, 3, "u"), (1, "b2", 1, 1, "u"), (1, "b2", 1, 0, "v")]
    got = {r.url: (r.cross_hits, r.avg_rank, r.backends) for r in serp.merge(spark.createDataFrame(rows, "query_id long, backend string, backend_pos int, rank int, url string")).collect()}
    assert got == {"u": (3, 2.0, ["b1", "b1", "b2"]), "v": (1, 0.0, ["b2"])}


def test_batch(spark, tmp_path):
    (tmp_path / "b.txt").write_text("# c\n\n query one \nhttps://example.com/page\n")
    assert [tuple(r) for r in batch.read_items(spark, str(tmp_path / "b.txt")).collect()] == [("query one", False), ("https://example.com/page", True)]
    assert batch.all_succeeded(spark.createDataFrame([("x",), ("",)], "text string")).first().status == 2
    assert batch.all_succeeded(spark.createDataFrame([], "text string")).first().status == 2


def test_keywords_of_rows(spark):
    rows = [("三体 and 三体 AI", "三体 三体"), ("mail AI mail", "AI"), ("mail", "AI"), ("x", None), ("x", ""), (None, "AI")]
    found = [r.m for r in spark.createDataFrame(rows, "t string, k string").coalesce(1).select(C.match_keywords("t", F.col("k")).alias("m")).collect()]
    assert [(m.hits, m.matches, m.positions) for m in found] == [(4, ["三体", "三体"], [0, 0]), (1, ["AI"], [5]), (0, [], []), (0, [], []), (0, [], []), (0, [], [])]
    texts = spark.createDataFrame([(1, 0, "u", "三体 " + "plain words here. " * 60, "三体"), (2, 0, "u", "plain words here. " * 60, "三体"), (3, 0, "u", "plain words here. " * 60, None)], "query_id long, pos int, url string, preview string, keyword string")
    assert sorted(r.query_id for r in select.verify(texts, keyword_required=True).collect()) == [1, 3]


def test_chain_compares_with_the_preview(spark):
    schema = "query_id long, url_rank int, url string, stage_index int, stage_name string, text string, preview string"
    text, other = "\n\n".join(f"Paragraph {k} has words enough to count for something." for k in range(120)), "完全不同的内容在这里，" * 40
    rows = [(1, 0, "u", 0, "s0", text, other), (2, 0, "u", 0, "s0", text, text[:2000]), (3, 0, "u", 0, "s0", text, "short"), (4, 0, "u", 0, "s0", text, None)]
    found = {r.query_id: r.result for r in select.chain(spark.createDataFrame(rows, schema), least=0.3).collect()}
    assert found == {1: "best_effort", 2: "validated", 3: "validated", 4: "validated"}


def test_chapter_lines(spark):
    text = "\n".join(["第 7 章 空 rest", '<a href="/a.html"> x', "https://abs.example/7", "第三章 雨", "https://one.example/3 'q'", "第十二节x", ".", ".", "零第零章", "第2回 https://two.example/2"])
    rows = [(r["rank"], r.number, r.title, r.url) for r in links.chapter_lines(spark.createDataFrame([(1, "https://s.example/d/9.html", text)], "key int, base string, text string")).orderBy("rank").collect()]
    assert rows == [(1, 2, "https://two.example/2", "https://two.example/2"), (2, 3, "雨", "https://one.example/3"), (3, 7, "空", "https://s.example/a.html"), (4, 12, "x", "https://s.example/d/12.html")]


def test_walks_end_at_the_next_chapter(spark):
    nav = [("a", "b", None), ("b", "c", ""), ("c", "d", "next"), ("d", "e", None), ("x", "y", None), ("y", "x", None), ("z", "z", None), ("q", "gone", None)] + [(f"n{k:02}", f"n{k + 1:02}", None) for k in range(30)]
    texts = [(u, f"text {u} 下载 tail") for u, *_ in nav]
    rows = links.follow(spark.createDataFrame(nav, "url string, next_page string, next_chapter string"), spark.createDataFrame(texts, "url string, text string"))
    found = {r.start: (r.pages, r.text) for r in rows.collect()}
    assert found["a"] == (3, "text a \n\ntext b \n\ntext c ") and found["c"][0] == 1 and found["x"][0] == 2 and found["z"][0] == 1
    assert found["q"] == (2, "text q ") and found["n00"][0] == 10 and found["n25"][0] == 6
    assert {r.start: r.pages for r in links.follow(spark.createDataFrame(nav, "url string, next_page string, next_chapter string"), spark.createDataFrame(texts, "url string, text string"), 4).collect()}["n03"] == 4


def test_heap_strings(spark):
    body = " text of a page" * 40
    junk = ['{"version": 1}' + body, ' {"a": 1, "disable": 2}' + body, '"encryptAttrs"' + body, '"events"' + body, "PG" + body, "<p>" + body + "</p>", "<br/>" + body]
    good = ['{"title": 1}' + body, "<3" + body, '["a"]' + body, "PG" + body[:300], "x" * 600 + '"events"']
    rows = [(k, 0, t) for k, t in enumerate([*junk, *good])] + [(99, 0, "short")]
    found = sorted(r.key for r in select.heap_string(spark.createDataFrame(rows, "key long, pos int, text string")).collect())
    assert found == list(range(len(junk), len(junk) + len(good)))


def test_merge_sources(spark):
    rows = [(1, 1, 0, "a", "", "x" * 100 + "\n"), (1, 1, 1, "b", "", "y" * 90), (2, 1, 0, "a", "", "x" * 100), (2, 1, 1, "b", "", "y" * 95), (2, 1, 2, "c", "T", "z" * 160)]
    schema = "work_id int, row int, source_idx int, source_name string, title string, text string"
    found = {r.work_id: (r.title, r.text, r.sources, r.confidence) for r in align.merge(spark.createDataFrame(rows, schema), "most_consistent").collect()}
    assert found == {1: ("第1章", "x" * 100, ["a"], 0.9), 2: ("第1章", "x" * 100 + "\n\n[补充内容 from c]\n" + "z" * 160, ["a", "c"], 0.7)}


def test_rendered_results(spark):
    rows = spark.createDataFrame([(1, 0, "q", "body", 0.5, "https://u.example/"), (1, 1, "r", None, None, None)], "key int, pos int, input string, text string, score double, url string")
    forms = {f: batch.document(rows, f).first().document for f in ("text", "md", "json")}
    assert forms["text"] == "body\n\n=====\n\n"
    assert forms["md"] == "# Batch results\n\n## q\n\n- Score: 0.500\n- URL: https://u.example/\n\nbody\n\n## r\n\n- Score: 0.000\n- URL: \n\n"
    found = json.loads(forms["json"])
    assert [r["input"] for r in found] == ["q", "r"] and list(found[0]) == ["input", *batch.RESULT] and found[0]["score"] == 0.5
    one_result = batch.results(spark.createDataFrame([(True, 0.75, "u", "t", "s", 12)], "success boolean, score double, url string, text string, winning_stage string, total_time_ms long"))
    assert one_result.select(batch.result_markdown()).first()[0] == "# Extraction result\n\n- Status: success\n- Score: 0.750\n- URL: u\n- Stage: s\n- Time: 12 ms\n\n## Content\n\nt\n"
    report = spark.createDataFrame([(1, 1, "u", 2, ["a", "b"]), (1, 2, "v", 1, ["a"])], "query_id int, rank int, url string, cross_hits int, backends array<string>")
    assert batch.search_report(report).first().report == "# Search results\n\n1. [u](u) — a, b\n2. [v](v) — a"
    assert batch.search_report(report, "text").first().report == "u\nv"


def test_decoding(spark):
    bodies = [("中文".encode("gbk"), None), ("中文".encode(), "latin-1"), ("中文".encode("big5"), "big5"), (b"\xff\xff\xff", "nonsense"), (None, None), ("é".encode("latin-1"), "latin-1")]
    found = [r[0] for r in spark.createDataFrame(bodies, "b binary, h string").coalesce(1).select(T.decoded("b", "h")).collect()]
    assert found == ["中文", "中文".encode().decode("latin-1"), "中文", "���", None, "é"]
    pages = spark.createDataFrame([(["a", "b"], ["{}", "<p>"]), (["a"], [])], "p array<string>, r array<string>").coalesce(1)
    assert [r[0] for r in pages.select(T.browser_text(F.col("p"), F.col("r"))).collect()] == ["a\n\nb\n\n{}\n---\n<p>", "a"]
    quick = spark.createDataFrame([("x" * 6000, "b"), ("short", "browser"), (None, "b")], "r string, b string").coalesce(1)
    assert [r[0] for r in quick.select(T.fast_text("r", "b")).collect()] == ["x" * 5000, "browser", "b"]


def test_first_chapters(spark):
    pages = spark.createDataFrame([("https://t.example/toc", 1, "<a href='/3'>第三章 c</a><a href='4.html'>第4章</a><a href='/3b'>第3章</a><a href='javascript:x'>第9章</a><a href='/5'>第五章</a>"), ("https://t.example/few", 2, "<a href='/1'>第1章</a>"), ("https://t.example/none", 3, "<p>")], "url string, page_id int, html string")
    found = [(r.number, r.chapter_url) for r in links.harvest(pages).orderBy("number").collect()]
    assert found == [(3, "https://t.example/3"), (4, "https://t.example/4.html"), (5, "https://t.example/5")]
    texts = spark.createDataFrame([("https://t.example/none", "第二章 b\nx\ny\n第一章 a\nhttps://c.example/1")], "url string, text string")
    assert {r.url: (r.title, r.chapter_url) for r in links.first_chapter(pages, texts).collect()} == {"https://t.example/toc": ("第三章 c", "https://t.example/3"), "https://t.example/few": ("第1章", "https://t.example/1"), "https://t.example/none": ("第1章 a", "https://c.example/1")}
    index = spark.createDataFrame([("u", "i" * 100, "novel_index", "c"), ("v", "i" * 100, "unknown", "c"), ("w", "i" * 300, "novel_index", "c")], "url string, text string, type string, chapter_url string")
    chosen = links.followed_chapter(index, spark.createDataFrame([("c", "t" * 120)], "chapter_url string, text string"))
    assert sorted((r.url, len(r.text)) for r in chosen.collect()) == [("c", 120), ("v", 100), ("w", 300)]


def test_slots_in_spans(spark):
    rows = [(f"d{k % 2}", float(k * k % 97), k) for k in range(200)]
    table = spark.createDataFrame(rows, "domain string, arrival double, pos long")
    whole, spans = ({r.pos: r.slot for r in schedule.slots(table, 1.5, bucket_rows=n).collect()} for n in (1000, 20))
    assert whole == spans
    last, plain = {}, {}
    for d, a, k in sorted(rows, key=lambda r: (r[1], r[2])):
        last[d] = plain[k] = a if d not in last else max(a, last[d] + 1.5)
    assert whole == plain


def test_contained(spark):
    texts = [(1, "abcdefghijkl"), (1, "cdefghijk"), (1, "bc"), (1, ""), (1, None), (2, "cdefghijk"), (1, "abcdefghijkl"), (1, "xbc")]
    found = sorted(map(str, (r.v for r in dedup.drop_contained(spark.createDataFrame(texts, "k int, v string"), "k", "v").collect())))
    assert found == sorted(["abcdefghijkl", "abcdefghijkl", "None", "cdefghijk", "xbc"])


def test_alignment_in_blocks(spark):
    """Against every ratio worked out, and with few of them worked out."""
    import random
    from difflib import SequenceMatcher

    random.seed(5)
    words = "the and of ring tion 天 地\U0001f600 ent".split()
    made = lambda n: "".join(random.choices(words, k=n))
    texts = [made(random.choice((0, 1, 5, 9, 120))) for _ in range(40)] + ["a" * 200, "a" * 200, "ab" * 100]
    works = [(0, 0, k, t) for k, t in enumerate(texts)] + [(0, s, k, t[s * 3 :] + made(s)) for s in (1, 2) for k, t in enumerate(texts) if (k + s) % 4]
    prints = {r.k: r.p for r in spark.createDataFrame([(k, w[3]) for k, w in enumerate(works)], "k int, v string").select("k", T.fingerprint("v").alias("p")).collect()}
    base = [(w, prints[k]) for k, w in enumerate(works) if w[1] == 0]
    want, served = {(0, n + 1, 0, w[2]) for n, (w, _) in enumerate(base)}, set()
    for n, (_, p) in enumerate(base):
        for s in (1, 2):
            ratios = [(SequenceMatcher(None, p, prints[k]).ratio(), -w[2]) for k, w in enumerate(works) if w[1] == s and p and prints[k]]
            if ratios and max(ratios)[0] >= 0.6:
                want.add((0, n + 1, s, -max(ratios)[1]))
                served.add((s, -max(ratios)[1]))
    alone = sorted((s, o) for _, s, o, _ in works if s and (s, o) not in served)
    want |= {(0, len(base) + 1 + n, s, o) for n, (s, o) in enumerate(alone)}
    rows = spark.createDataFrame(works, "work_id int, source_idx int, ordinal int, text string")
    for size in ({}, {"block": 7, "blocks": 2}):
        found = [tuple(r) for r in align.align(rows, **size).collect()]
        assert len(found) == len(want) and set(found) == want
    bounds = align._Bounds([p for _, p in base])
    assert all(b >= SequenceMatcher(None, p, q).ratio() for q in list(prints.values())[::5] for (_, p), b in zip(base, bounds.of(q)) if p and q)


def test_texts_cross_once_and_in_slices(spark):
    import tracemalloc

    import pyarrow as pa
    from corpusflow.functions import scoring

    texts = pa.array([f"{k} " + "text " * 2000 for k in range(4000)])
    tracemalloc.start()
    scored = scoring.score_of.func(texts, pa.nulls(len(texts), pa.string()))
    bodies = pa.array([b"x" * 10000] * 4000)
    decoded = T._decoder().func(bodies, pa.nulls(len(bodies), pa.string()))
    dug = json_dig._dig.func(pa.array(['{"a": "' + "word " * 2000 + '"}'] * 4000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (len(scored), len(decoded), len(dug)) == (4000,) * 3 and decoded[3999].as_py() == "x" * 10000 and dug[3999].as_py() == "word " * 2000
    assert peak < 16 << 20, peak
    assert [list(scoring.each(pa.array([], pa.string()))), len(scoring.strings([]))] == [[], 0]


def test_filters_on_scores_call_them_once(spark):
    rows = spark.createDataFrame([(1, 1, "some text", 0)], "key int, layer int, text string, pos int")
    seen = spark.createDataFrame([(1, 0, "u", "some text")], "query_id int, pos int, url string, preview string")
    for found in (select.pick_layer(rows), select.verify(seen)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_contained_in_large_keys(spark):
    import random

    random.seed(7)
    made = [(k, "".join(random.choices("ab\n中\U0001f600", k=random.randrange(0, 14)))) for k in (1, 2, None) for _ in range(120)] + [(1, None), (None, None), (3, ""), (4, "x" * 70000 + "yz"), (4, "xxxyz"), (4, "z"), (4, "zy")]
    rows = spark.createDataFrame(made, "k int, v string")
    kept = sorted(map(str, (r for r in made if r[0] is None or r[1] is None or not any(k == r[0] and w is not None and len(w) > len(r[1]) and r[1] in w for k, w in made))))
    for most_work, most_chars in ((1 << 28, 1 << 24), (0, 0), (1 << 28, 1000)):
        found = dedup.drop_contained(rows, "k", "v", most_work=most_work, most_chars=most_chars)
        assert sorted(str((r.k, r.v)) for r in found.collect()) == kept
        # a table of stretches must not be broadcast by the size of its source
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_many_results(spark):
    rows = [(1, 0, "u", "a", 0.9), (1, 1, "u", "b", 0.9), (1, 2, "v", "c", 0.9), (2, 0, "u", "a", 0.1), (2, 1, "v", "b", 0.9), (3, 0, "u", "", 0.9)]
    found = dedup.best_of_many(spark.createDataFrame(rows, "query_id int, round int, url string, text string, score double"))
    assert sorted((r.query_id, r.round) for r in found.collect()) == [(1, 0), (1, 2), (2, 0)]
    one_site, two = (spark.createDataFrame([(0, u, p), (1, "", p)], "pos long, url string, platform string") for u, p in (("a", "x"), ("a", "y")))
    assert sorted((r.url, r.platform) for r in dedup.across_platforms([one_site, two]).collect()) == [("", "x"), ("", "y"), ("a", "x")]
    sites = spark.createDataFrame([("/j/1", "boss"), ("j/1", "liepin"), ("https://x", "boss"), ("/j", "other"), (None, "boss")], "u string, p string").coalesce(1)
    assert [r[0] for r in sites.select(jobs.absolute("u", "p")).collect()] == ["https://www.zhipin.com/j/1", "https://www.liepin.com/j/1", "https://x", "/j", ""]


def test_layers(spark):
    whole = "\n\n".join(f"Paragraph {k} has words enough to count for something." for k in range(150))
    rows = [(1, 1, whole, 0), (1, 3, "x" * 9000, 1), (2, 1, "thin " * 20, 0), (2, 3, "y" * 300, 1), (2, 2, "z" * 400, 2), (3, 5, " " * 99 + "o" * 60, 0), (4, 4, "tiny", 0)]
    layers = spark.createDataFrame(rows, "key int, layer int, text string, pos int")
    assert {r.key: (r.layer, r.tier) for r in select.quick_or_full(layers).collect()} == {1: (1, 0), 2: (3, 2), 3: (5, 4)}
    assert {r.key: r.layer for r in select.first_layer(layers).collect()} == {1: 1, 2: 1, 3: 5}


def test_cross_validation(spark):
    found = spark.createDataFrame([(1, True), (2, False), (3, True)], "query_id long, success boolean")
    chapters = [(q, s, f"s{s}", k, "", f"chapter {k} of the book " * 10 + "more " * (9 * s)) for q in (1, 2) for s in (0, 1) for k in (0, 1)]
    rows = {r.query_id: r for r in pipeline.cross_validated(found, spark.createDataFrame(chapters, "query_id long, source_idx int, source_name string, ordinal int, title string, text string")).collect()}
    assert [rows[k].cross_validated for k in (1, 2, 3)] == [True, False, False]
    assert rows[1].cross_text.count("第1章") == 1 and "more" in rows[1].cross_text


def test_exports():
    import corpusflow

    assert len(corpusflow.__all__) > 60 and all(callable(getattr(corpusflow, name)) for name in corpusflow.__all__)
    with pytest.raises(AttributeError):
        corpusflow.nothing
