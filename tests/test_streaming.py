"""Streams give what batches give."""

from corpusflow.functions.text import completeness
from corpusflow.operators import schedule
from corpusflow.streaming import crawl, limiter


def test_slots(spark, tmp_path):
    rows = [("d" if k % 3 else "e", float(k * k % 7 + k), k) for k in range(30)]
    schema = "domain string, arrival double, pos long"
    all_rows = spark.createDataFrame(sorted(rows, key=lambda r: r[1]), schema)
    for part in range(2):
        own = sorted(rows, key=lambda r: r[1])[part * 15 : part * 15 + 15]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = limiter.slots(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2.0)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.domain, r.pos): r.slot for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.domain, r.pos): r.slot for r in schedule.slots(all_rows, 2.0).collect()}


def test_best_texts(spark, tmp_path):
    schema = "url string, text string"
    rows = [("u", "short. " * 40), ("u", "A longer text. " * 90), ("v", "other words here. " * 30)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    best = limiter.best_texts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    best.writeStream.format("memory").queryName("best").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    got = {r.url: r.text for r in spark.table("best").collect()}
    scores = {t: spark.createDataFrame([(t,)], "t string").select(completeness("t")).first()[0] for _, t in rows}
    assert got == {u: max((t for v, t in rows if v == u), key=scores.get) for u in "uv"}


def test_crawl_resumes(spark, tmp_path):
    schema = "page_id long, url string, html string"
    for k in range(2):
        spark.createDataFrame([(k, f"u{k}", "<p>" + "words " * 40)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
        crawl.resume(spark, str(tmp_path / "pages"), schema, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r.page_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1]
