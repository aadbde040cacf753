"""The longest text inside a JSON value."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import starmap

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusflow.functions import rules, scoring


def _texts(value: object, depth: int, most: int) -> Iterator[str]:
    if depth > most:
        return
    if isinstance(value, dict):
        for v in value.values():
            if isinstance(v, str):
                if len(v) > 50 and not any(m in v for m in rules.CODE_MARKS):
                    yield v
            elif isinstance(v, (dict, list)):
                yield from _texts(v, depth + 1, most)
    elif isinstance(value, list) and len(value) < 500:
        for v in value:
            if isinstance(v, (dict, list)):
                yield from _texts(v, depth + 1, most)


@F.arrow_udf(StringType())
def _dig(bodies: pa.Array) -> pa.Array:
    def one(body: str | None) -> str | None:
        try:
            return max(_texts(json.loads(body), 0, 5), key=len, default=None) if body else None
        except (ValueError, RecursionError):
            return None

    return scoring.strings(starmap(one, scoring.each(bodies)))


def longest_text(body: Column | str) -> Column:
    """The longest string of over 50 characters that isn't code, the first of equals: values of objects to depth 5,
    through lists of under 500 items. Strings that are list items themselves don't count. The depth of a value is
    unknown to a schema, hence Python."""
    return _dig(body)
