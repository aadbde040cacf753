"""Extraction stages as registered expressions over fetched pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as T


@dataclass(frozen=True)
class Stage:
    """text: the stage's text as an expression over fetches; handles: the rows it can handle."""

    name: str
    index: int
    text: Callable[[], Column]
    handles: Callable[[], Column] = field(default=lambda: F.lit(True))


class Registry:
    """Stages by name; a second one of a name replaces the first. The chain is in order of index."""

    def __init__(self, stages: list[Stage] | None = None) -> None:
        self._stages = {s.name: s for s in (DEFAULT if stages is None else stages)}

    def register(self, stage: Stage) -> None:
        self._stages[stage.name] = stage

    def chain(self, names: list[str] | None = None, first: int | None = None) -> list[Stage]:
        """The stages in order: those named, or the first so many."""
        found = sorted((s for s in self._stages.values() if names is None or s.name in names), key=lambda s: s.index)
        return found[:first]

    def outputs(self, fetches: DataFrame, keep: list[str], **chosen) -> DataFrame:
        """keep, stage_index, stage_name and text: a row per fetched page and stage that handles it, in one scan."""
        rows = [F.when(s.handles(), F.struct(F.lit(s.index).alias("stage_index"), F.lit(s.name).alias("stage_name"), s.text().alias("text"))) for s in self.chain(**chosen)]
        return fetches.select(*keep, F.explode(F.array_compact(F.array(*rows))).alias("s")).select(*keep, "s.*")


def _acquired(column: str) -> Callable[[], Column]:
    return lambda: F.col(column)


#: What needs a browser, a screen or a model arrives as a column of the fetches.
DEFAULT = [
    Stage("jina_reader", 0, lambda: T.strip_reader_header(F.col("reader_text")), lambda: F.col("reader_text").isNotNull()),
    Stage("curl_cffi_http", 1, lambda: T.html_to_text(T.capped_html("html")), lambda: F.col("html").isNotNull() & F.col("status").between(200, 399)),
    *[Stage(name, k, _acquired(f"{name}_text"), lambda name=name: F.col(f"{name}_text").isNotNull()) for k, name in enumerate(("browser_dom", "canvas_hook", "cdp_heap", "screenshot_ocr", "vision_llm"), 2)],
]


def fetches(rows: DataFrame) -> DataFrame:
    """rows with every column that the default stages read; missing ones are null."""
    wanted = {"status": "int", "html": "string", "reader_text": "string"} | {f"{s.name}_text": "string" for s in DEFAULT[2:]}
    return reduce(lambda d, c: d if c in d.columns else d.withColumn(c, F.lit(None).cast(wanted[c])), wanted, rows)
