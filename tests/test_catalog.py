"""Each query that has SQL against it."""

import re
from collections import Counter

import duckdb
import pytest

from corpusflow import catalog
from corpusflow.operators import jobs
from corpusflow.plans import fixtures

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


def plain(rows):
    out = [tuple(round(v, 9) if isinstance(v, float) else int(v) if type(v).__name__ == "Decimal" else v for v in r) for r in rows]
    return sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.SQL[name]})").fetchall()
    assert plain(map(tuple, found.select(*columns).collect())) == plain(expected)


def test_every_query_without_sql_runs(spark):
    for name in catalog.QUERIES.keys() - catalog.SQL.keys():
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_chapter_align_takes_every_document(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    found = catalog.QUERIES["chapter_align"](spark, SF).where("source_idx = 0").select("work_id", "ordinal").distinct().collect()
    works = {}
    for r in documents:
        works[r.doc_id // 30] = works.get(r.doc_id // 30, 0) + 1
    assert sorted(map(tuple, found)) == sorted((w, k + 1) for w, n in works.items() for k in range(n))


def test_auto_clean_of_whole_texts(spark):
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    books = {r.key: r.text for r in catalog._book(spark, SF).collect()}
    assert all(text in books[i // 10] for i, text in documents.items())
    for r in catalog.QUERIES["auto_clean"](spark, SF).collect():
        parts = re.split(r"={10,}\n第\d+章\n={10,}", books[r.key])
        tails = Counter(p.strip()[-800:] for p in parts)
        text = books[r.key]
        for tail, n in tails.most_common(3):
            if len(parts) >= 4 and tail and n >= max(3, len(parts) / 2):
                assert len(tail) == 800
                text = text.replace(tail, "")
        assert len(text) < len(books[r.key])
        assert r.text == re.sub(r"\n{4,}", "\n\n\n", text)


def trimmed(text, most=8000):
    if len(text) <= most:
        return text
    menu, head = re.compile(r"^\s*$|^(?:" + "|".join(jobs._MENU.split()) + r").{0,30}$"), int(most * 0.67)
    kept = "\n".join(x for x in text.split("\n") if not menu.search(x.strip()))
    if len(kept) <= most:
        return kept
    tail = ""
    for x in kept[head:].split("\n"):
        if any(w in x for w in jobs._WANTED):
            if len(tail) + len(x) + 1 > most - head:
                break
            tail += x + "\n"
    return kept[:head] + "\n" + tail


def test_every_text_is_trimmed(spark):
    texts = {r.doc_id: r.text for r in fixtures.documents(spark, SF).collect() if r.text is not None}
    found = catalog.QUERIES["llm_trim"](spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    assert all(r.short == trimmed(texts[r.doc_id]) for r in found)
    assert any(len(t) > 8000 for t in texts.values())


def test_trim_rules(spark):
    wanted, other = "要求 " + "a" * 996, "b" * 999
    texts = {
        0: "\n".join(["首页 x", "  ", *[other] * 7, "登录"] + ["关于 " + "c" * 20] * 90),
        1: "\n".join(["首页 x", *[other] * 6, wanted, other, wanted, wanted, wanted]),
        2: "\n".join(["注册", *[other] * 9]),
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").select("doc_id", jobs.trim("text").alias("short")).collect()
    assert {r.doc_id: r.short for r in rows} == {k: trimmed(t) for k, t in texts.items()}
    assert [len(trimmed(t)) for t in texts.values()] == [6999, 5361 + 2 * 1000, 5361]
