"""Verbs and stages."""

from pyspark.sql import functions as F

from corpusflow import cli
from corpusflow.plans.stages import Registry, Stage, fetches


def test_stages(spark):
    registry = Registry()
    assert [s.name for s in registry.chain()] == "jina_reader curl_cffi_http browser_dom canvas_hook cdp_heap screenshot_ocr vision_llm".split()
    registry.register(Stage("curl_cffi_http", 1, lambda: F.lit("mine")))
    pages = fetches(spark.createDataFrame([("u", 200, "<p>x", "Title: a\n\nbody"), ("v", 404, "<p>y", None)], "url string, status int, html string, reader_text string"))
    rows = {(r.url, r.stage_index): r.text for r in registry.outputs(pages, ["url"], first=2).collect()}
    assert rows == {("u", 0): "body", ("u", 1): "mine", ("v", 1): "mine"}


def test_extract_and_run(spark, tmp_path):
    text = "A sentence of words. " * 300
    spark.createDataFrame([("https://a.example/1", 200, f"<p>{text}</p>"), ("https://a.example/2", 500, "<p>x")], "url string, status int, html string").write.parquet(str(tmp_path / "f"))
    spark.createDataFrame([(1, "b", 0, 0, "https://a.example/1"), (1, "b", 0, 1, "https://a.example/login")], "query_id long, backend string, backend_pos int, rank int, url string").write.parquet(str(tmp_path / "s"))
    (tmp_path / "items").write_text("# x\nhttps://a.example/1\nquery\n")
    common = ["--output", str(tmp_path / "o"), "--min-score", "0.3"]
    for argv in (["extract", "--fetches", str(tmp_path / "f")], ["batch", "--items", str(tmp_path / "items"), "--fetches", str(tmp_path / "f")], ["run", "--serp", str(tmp_path / "s"), "--fetches", str(tmp_path / "f")]):
        assert cli.main(argv + common) == 0
        (row,) = spark.read.parquet(str(tmp_path / "o")).where("success").collect()
        assert row.text == text.strip() and row.winning_stage == "curl_cffi_http"
    assert cli.main(["search", "--serp", str(tmp_path / "s"), *common]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    for argv, part in ((["extract", "--fetches", str(tmp_path / "f")], "- Status: success"), (["batch", "--items", str(tmp_path / "items"), "--fetches", str(tmp_path / "f")], "# Batch results"), (["search", "--serp", str(tmp_path / "s")], "1. [https://a.example")):
        assert cli.main([*argv, "--output", str(tmp_path / "t"), "--min-score", "0.3", "--format", "md"]) == 0
        assert part in "\n".join(r.value for r in spark.read.text(str(tmp_path / "t")).collect())
