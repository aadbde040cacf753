"""The corpus pipeline and the registered queries."""

import re
from pathlib import Path
from urllib.parse import urlparse

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", text.lower())


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, written and read as run() does."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_stages_keep_the_columns(stages):
    assert list(stages) == ["documents", "toxicity", "exact_dedup", "jaccard_join", "packing"]
    assert all(stages[name].columns == COLUMNS for name in ("toxicity", "exact_dedup", "jaccard_join"))


def test_exact_copies_go(stages):
    before, after = stages["toxicity"].collect(), {r.doc_id: r.text for r in stages["exact_dedup"].collect()}
    first = {}
    for r in before:
        first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    assert after == {i: t for t, i in first.items()}


def test_near_copies_go(stages):
    texts = {r.doc_id: r.text for r in stages["exact_dedup"].collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {r.doc_id for r in stages["jaccard_join"].collect()} == {i for i in ids if root(i) == i}


def test_packs_hold_what_was_left(stages):
    texts = {r.doc_id: r.text for r in stages["jaccard_join"].collect()}
    pieces = {}
    for p in stages["packing"].collect():
        for i, s, n in zip(p.doc_ids, p.starts, p.lengths):
            pieces.setdefault(i, []).append((s, n))
    assert {i: "".join(texts[i][s : s + n] for s, n in sorted(x)) for i, x in pieces.items()} == {i: t for i, t in texts.items() if t}


def test_awkward_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows and an empty table, with labels of both classes, of one, and of none."""
    toxic, clean = "you are a worthless idiot", "what a lovely day it is today"
    rows = [(k, f"{toxic if k % 2 else clean} {k} " * 3, None, None, None) for k in range(40)] + [(50, None, "en", "s", 1), (51, "", "en", "s", 0), (52, "same text", None, "s", 9), (52, "same text", None, "s", 9), (None, "lost", None, None, 4), (53, "same text", None, "t", 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for n, labels in enumerate(([(k, k % 2) for k in range(40)], [(k, 1) for k in range(5)], [])):
        folder = str(tmp_path / str(n))
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs.write.parquet(f"{folder}/documents.parquet")
        kept = {name: stage(spark, docs, folder).collect() for name, stage in corpus_pipeline.STAGES}
        assert {r.doc_id for r in kept["toxicity"]} >= {50, 51, None} and (n or {r.doc_id for r in kept["toxicity"]} & set(range(40)) == set(range(0, 40, 2)))
        assert sum(r.text == "same text" for r in kept["exact_dedup"]) == 1 and {r.doc_id for r in kept["exact_dedup"]} >= {50, 51, 52, None}
        assert sum(r.doc_id == 52 for r in kept["jaccard_join"]) == 2 and {r.doc_id for r in kept["jaccard_join"]} >= {50, 51, None} and 53 not in {r.doc_id for r in kept["jaccard_join"]}
        empty = docs.limit(0)
        assert all(stage(spark, empty, folder).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_run_leaves_only_the_last_table(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    folder = Path(urlparse(found.inputFiles()[0]).path).parent.parent
    assert [p.name for p in folder.iterdir()] == ["3_packing"]
    assert sorted(map(str, found.collect())) == sorted(map(str, stages["packing"].collect()))


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_queries_against_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = __spark_entry__.queries()[name](spark, SF)
    expected = con.execute(f"SELECT {', '.join(sorted(found.columns))} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, found.select(*sorted(found.columns)).collect()))) == sorted(map(str, expected))


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.queries() if n.startswith("op") and n not in __spark_entry__.oracle_sql()))
def test_queries_without_sql_run(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0
