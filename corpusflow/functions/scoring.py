"""Scores of whole texts, as plain functions over strings and as Arrow functions over columns.

A score needs dozens of searches and counts in one text. As one expression they are too much for one generated method
and are interpreted; here a text crosses to Python once, in batches, and strings are searched by C code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import islice, starmap
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions import rules

_GAP = re.compile(r"\n\s*\n")
_ITEM = re.compile(r"^\s*[-*]\s", re.M)
_PRIVATE = re.compile("[\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd]")
_HAN = re.compile("[一-鿿]")


def _held(text: str, words: list[str]) -> int:
    return sum(w in text for w in words)


def boilerplate(text: str) -> int:
    return _held(text.lower(), rules.BOILERPLATE)


def completeness(text: str | None) -> float:
    """How complete an article a text looks, 0 to 0.93; texts of under 100 characters score 0. None scores 0."""
    t = (text or "").strip()
    n = len(t)
    if n < 100:
        return 0.0
    top = t[:800]
    lines = [x for x in t.split("\n") if x and not x.isspace()]
    rows = max(len(lines), 1)
    skeleton = _held(top, rules.SKELETON) + ("loading" in top.lower())
    score = (
        min(n / 5000.0, 1.0) * 0.30
        + min(len(_GAP.findall(t)) / 15.0, 1.0) * 0.20
        + min(sum(map(t.count, "。！？.!?\n")) / rows, 1.0) * 0.15
        + min(sum(len(x) > 80 for x in lines) / rows * 2, 1.0) * 0.10
        - min(boilerplate(top) * 0.04 + skeleton * 0.06, 0.25)
        + min(len(set(t)) / n * 5, 1.0) * 0.10
        + (0.05 if any(c in t for c in "│┌├└─|") else 0.0)
        + (0.03 if _ITEM.search(t) else 0.0)
    )
    return max(min(score, 1.0), 0.0)


def density_curve(text: str, parts: int = 5) -> list[float]:
    """Shares of visible characters in `parts` equal pieces (the remainder is left out); empty for the empty text."""
    size = max(len(text) // parts, 1)
    return [min(len("".join(text[i * size : (i + 1) * size].split())) / size, 1.0) for i in range(parts)] if text else []


def _trigrams(text: str) -> np.ndarray:
    codes = np.frombuffer("".join(text.lower().split())[:4000].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.unique((codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]) if len(codes) > 2 else codes[:0]


def consistency(one: str, two: str) -> float:
    """Shared share of the smaller set of character trigrams (lowered, without white space, 4000 characters at most);
    1 if either has none."""
    a, b = _trigrams(one), _trigrams(two)
    least = min(len(a), len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / least if least else 1.0


def _finder(pattern: str) -> Callable[[str], bool]:
    """Whether a pattern is in a text; plain words are looked for as such."""
    if not re.search(r"[\\\[\](){}.*+?^$]", pattern):
        words = pattern.split("|")
        return lambda text: any(w in text for w in words)
    found = re.compile(pattern).search
    return lambda text: found(text) is not None


@cache
def _signatures() -> list[tuple[str, int, list, list]]:
    both = lambda pairs: [(_finder(p), w) for p, w in pairs]
    return [(s.kind, s.least, both(s.must), both(s.others)) for s in rules.SIGNATURES]


def content_type(text: str) -> tuple[str, int]:
    """The signature with the highest positive score, the earlier one at ties; else unknown, 0."""
    kind, best = "unknown", 0
    for name, least, must, others in _signatures():
        if len(text) >= least and (own := [w for find, w in must if find(text)]):
            total = sum(own) + sum(w for find, w in others if find(text))
            if total > best:
                kind, best = name, total
    return kind, best


class Match(NamedTuple):
    hits: int
    density: float
    head_bonus: bool
    matches: list[str]
    positions: list[int]


@cache
def _words(keyword: str) -> list[tuple[str, str, re.Pattern | None]]:
    """The words of two or more characters, lowered, and the pattern of those that aren't half CJK."""
    words = [w for w in keyword.split() if len(w) >= 2]
    cjk = lambda w: sum("一" <= c <= "鿿" for c in w) >= len(w) * 0.5
    return [(w, w.lower(), None if cjk(w) else re.compile(f"(?<![a-zA-Z]){re.escape(w.lower())}(?![a-zA-Z])")) for w in words]


def match_keywords(text: str | None, keyword: str | None) -> Match:
    """Words of two or more characters, as substrings where half of a word is CJK, else not inside longer runs of Latin
    letters. A word given twice counts twice. Density: hits per 100 characters."""
    low, n = (text or "").lower(), max(len(text or ""), 1)
    hits, matches, positions = 0, [], []
    for word, lowered, pattern in _words(keyword or ""):
        found = low.count(lowered) if pattern is None else len(pattern.findall(low))
        if found:
            hits += found
            matches.append(word)
            positions.append(low.find(lowered) if pattern is None else pattern.search(low).start())
    return Match(hits, hits / (n / 100.0), any(p < n * 0.2 for p in positions), matches, positions[:5])


class Score(NamedTuple):
    quality: float
    type: str
    type_confidence: float
    dense: bool
    index_page: bool
    keyword_density: float
    keyword_head_bonus: bool


def _step(value: int, *steps: tuple[int, float]) -> float:
    return next((gain for least, gain in steps if value >= least), 0.0)


def score_content(text: str | None, keyword: str | None) -> Score:
    """Texts of under 50 characters are empty. dense and index_page are the signals of walls and of tables of contents.
    A null or empty keyword gives neither density nor bonus."""
    t = (text or "").strip()
    if len(t) < 50:
        return Score(0.0, "empty", 0.0, False, False, 0.0, False)
    kind, best = content_type(t)
    walls = boilerplate(t[:500])
    quality = (
        _step(len(t), (2000, 0.35), (1000, 0.25), (500, 0.15), (200, 0.08))
        + _step(len(_GAP.findall(t)), (10, 0.20), (5, 0.12), (2, 0.06))
        + _step(sum(map(t.count, "。！？.!?\n")), (20, 0.15), (5, 0.08))
        + _step(walls, (3, -0.25), (1, -0.10))
        + (-0.15 if kind == "novel_index" else 0.0)
    )
    match = match_keywords(t, keyword) if keyword else Match(0, 0.0, False, [], [])
    if keyword:
        quality = quality + (0.10 if match.head_bonus else 0.0) + min(match.density * 8, 0.15)
    return Score(max(min(quality, 1.0), 0.0), kind, min(best / 40.0, 1.0), walls >= 3, kind == "novel_index", match.density, match.head_bonus)


class Verdict(NamedTuple):
    passes: bool
    passed: int
    failed: int
    checks: list[str]
    completeness: float
    consistency: float | None


def validate(text: str | None, baseline: str | None, keyword: str | None, least: float, front: float, full: float | None) -> Verdict:
    """Eight checks of an extracted text. failed counts all that fail; passed only those of completeness, keyword, curve
    and consistency that hold. checks names the failed ones. None is checked as the empty text. A baseline or text of
    under 200 characters, or none, leaves consistency open. full is the text's completeness where it is known."""
    t = text or ""
    full = completeness(t) if full is None else full
    checks = [] if full >= least else ["completeness"]
    passed = int(full >= least)
    if keyword:
        has = keyword.lower() in t.lower()
        passed += has
        checks += [] if has else ["keyword"]
    curve = density_curve(t)
    if curve:
        heavy = curve[0] > 0 and curve[4] / curve[0] < front
        passed += not heavy
        checks += ["front_heavy"] if heavy else []
    checks += ["font_encryption"] if _PRIVATE.search(t[:2000]) else []
    checks += ["boilerplate"] if boilerplate(t[:500]) >= 3 else []
    if keyword and any("一" <= c <= "鿿" for c in keyword[:10]) and len(t) > 500 and len(_HAN.findall(t[:2000])) / len(t[:2000]) < 0.05:
        checks.append("language")
    checks += ["too_short"] if len("".join(t.split())) < 100 else []
    same = consistency(t, baseline) if baseline is not None and len(t) >= 200 and len(baseline) >= 200 else None
    if same is not None:
        passed += same >= 0.05
        checks += [] if same >= 0.05 else ["inconsistent"]
    return Verdict(not checks, passed, len(checks), checks, full, same)


# the same over columns


def each(*columns: pa.Array, size: int = 64) -> Iterator[tuple]:
    """The rows of columns, `size` of them as Python values at a time: a batch of texts is large enough once."""
    for at in range(0, len(columns[0]), size):
        yield from zip(*(c.slice(at, size).to_pylist() for c in columns))


def strings(values: Iterable[str | None], size: int = 64) -> pa.Array:
    """Values as one array, without a list of all of them."""
    values, parts = iter(values), []
    while part := list(islice(values, size)):
        parts.append(pa.array(part, pa.string()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.StructArray:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def _struct(kinds: dict[str, pa.DataType]) -> T.StructType:
    spark = {pa.int32(): T.IntegerType(), pa.float64(): T.DoubleType(), pa.bool_(): T.BooleanType(), pa.string(): T.StringType(), _TEXTS: T.ArrayType(T.StringType()), _INTS: T.ArrayType(T.IntegerType())}
    return T.StructType([T.StructField(name, spark[kind]) for name, kind in kinds.items()])


_TEXTS, _INTS = pa.list_(pa.string()), pa.list_(pa.int32())
_MATCH = {"hits": pa.int32(), "density": pa.float64(), "head_bonus": pa.bool_(), "matches": _TEXTS, "positions": _INTS}
_SCORE = {"quality": pa.float64(), "type": pa.string(), "type_confidence": pa.float64(), "dense": pa.bool_(), "index_page": pa.bool_(), "keyword_density": pa.float64(), "keyword_head_bonus": pa.bool_()}
_VERDICT = {"passes": pa.bool_(), "passed": pa.int32(), "failed": pa.int32(), "checks": _TEXTS, "completeness": pa.float64(), "consistency": pa.float64()}
_KIND = {"type": pa.string(), "score": pa.int32()}


@F.arrow_udf(T.DoubleType())
def completeness_of(text: pa.Array) -> pa.Array:
    return pa.array(starmap(completeness, each(text)), pa.float64())


@F.arrow_udf(T.DoubleType())
def consistency_of(one: pa.Array, two: pa.Array) -> pa.Array:
    return pa.array([None if a is None or b is None else consistency(a, b) for a, b in each(one, two)], pa.float64())


@F.arrow_udf(_struct(_KIND))
def content_type_of(text: pa.Array) -> pa.Array:
    return _table([(None, None) if t is None else content_type(t) for (t,) in each(text)], _KIND)


@F.arrow_udf(_struct(_MATCH))
def match_of(text: pa.Array, keyword: pa.Array) -> pa.Array:
    return _table(list(starmap(match_keywords, each(text, keyword))), _MATCH)


@F.arrow_udf(_struct(_SCORE))
def score_of(text: pa.Array, keyword: pa.Array) -> pa.Array:
    return _table(list(starmap(score_content, each(text, keyword))), _SCORE)


@F.arrow_udf(_struct(_VERDICT))
def verdict_of(text: pa.Array, baseline: pa.Array, keyword: pa.Array, least: pa.Array, front: pa.Array, full: pa.Array) -> pa.Array:
    return _table(list(starmap(validate, each(text, baseline, keyword, least, front, full))), _VERDICT)


#: The same, evaluated once a row: a filter on the result stays above it and doesn't call it again, in a worker of its own.
completeness_once = F.arrow_udf(completeness_of.func, T.DoubleType()).asNondeterministic()
score_once = F.arrow_udf(score_of.func, _struct(_SCORE)).asNondeterministic()


def keyword_column(keyword: Column | str | None) -> Column:
    """A keyword for all rows, one for each, or none."""
    return keyword if isinstance(keyword, Column) else F.lit(keyword).cast("string")
