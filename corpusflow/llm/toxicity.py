"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.common import cut, fresh, table

ORDERS = (3, 4, 5)
SLICE = 1 << 20
_MIX = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class ToxicityModel:
    """weights: one per hashed n-gram (2^bits floats, whatever the corpus); a document is rejected at score >= threshold."""

    weights: np.ndarray
    bias: float
    threshold: float
    bits: int


def _hashed(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Slot of the n-gram that starts at each position."""
    m = len(codes) - n + 1
    h = np.full(max(m, 0), n * 7919, dtype=np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h ^= codes[k : k + m]
    h *= _MIX
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return h >> np.uint32(32 - bits)


def _slices(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, code points, starts, ends) with about SLICE code points each; ends count the positions at which an
    n-gram may start. Longer texts are cut with an overlap that holds each n-gram once."""
    over = max(ORDERS) - 1
    owners: list[int] = []
    parts: list[str] = []
    cores: list[int] = []
    size = 0

    def out():
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        return owners, codes, starts, np.stack([lengths, np.array(cores, dtype=np.int64)])

    for i, text in enumerate(texts):
        text = f" {' '.join((text or '').lower().split())} "
        for at in range(0, len(text), SLICE):
            part = text[at : at + SLICE + over]
            owners.append(i)
            parts.append(part)
            cores.append(min(SLICE, len(text) - at))
            size += len(part)
            if size >= SLICE:
                yield out()
                owners, parts, cores, size = [], [], [], 0
    if parts:
        yield out()


def sums(texts: list[str | None], weights: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of weights over all n-grams of each text, and how many these are."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for owners, codes, starts, (lengths, cores) in _slices(texts):
        for n in ORDERS:
            slots = _hashed(codes, n, bits)
            upto = np.concatenate(([0.0], np.cumsum(weights[slots], dtype=np.float64)))
            stop = starts + np.clip(np.minimum(cores, lengths - n + 1), 0, None)
            np.add.at(total, owners, upto[np.minimum(stop, len(slots))] - upto[np.minimum(starts, len(slots))])
            np.add.at(count, owners, (stop - starts).astype(np.float64))
    return total, count


def _sparse(texts: list[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct slots and their counts, one text after another."""
    for text in texts:
        found = [_hashed(codes, n, bits)[a : a + max(0, min(core, length - n + 1))] for _, codes, starts, (lengths, cores) in _slices([text]) for a, length, core in zip(starts, lengths, cores) for n in ORDERS]
        yield np.unique(np.concatenate(found), return_counts=True)


@dataclass(frozen=True)
class Examples:
    """Distinct slots and their counts, text after text (begin: where each text's start), and which texts are toxic."""

    slots: np.ndarray
    counts: np.ndarray
    begin: np.ndarray
    toxic: np.ndarray

    @staticmethod
    def of(texts: list[str | None], toxic: list[int], bits: int) -> Examples:
        slots, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for s, c in _sparse(texts, bits):
            slots.append(s.astype(np.uint32))
            counts.append(c.astype(np.uint32))
        begin = np.cumsum([len(s) for s in slots])
        joined = np.concatenate(slots)
        del slots
        return Examples(joined, np.concatenate(counts), begin, np.array(toxic, dtype=np.float64))


def log_count_ratios(examples: Examples, use: np.ndarray, bits: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each slot log (p / |p|) / (q / |q|), where p and q are alpha plus in how many of the toxic and the other texts
    among `use` it occurs; and in how many of both it does."""
    p, q = np.zeros(1 << bits), np.zeros(1 << bits)
    for k in np.flatnonzero(use):
        (p if examples.toxic[k] else q)[examples.slots[examples.begin[k] : examples.begin[k + 1]]] += 1
    return np.log(((alpha + p) / (alpha + p).sum()) / ((alpha + q) / (alpha + q).sum())), p + q


def minimise(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; f gives value and gradient."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, kept = -g, []
        for s, y, rho in reversed(pairs):
            kept.append(rho * (s @ d))
            d = d - kept[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, np.linalg.norm(d))
        for (s, y, rho), a in zip(pairs, reversed(kept)):
            d = d + s * (a - rho * (y @ d))
        slope, t = g @ d, 1.0
        if slope > -1e-12:
            break
        while True:
            moved = x + t * d
            new, grad = f(moved)
            if new <= value + 1e-4 * t * slope or t < 1e-8:
                break
            t /= 2
        s, y = moved - x, grad - g
        if s @ y > 1e-14:
            pairs = [*pairs, (s, y, 1.0 / (s @ y))][-memory:]
        done = value - new < 1e-7 * max(1.0, abs(value))
        x, value, g = moved, new, grad
        if done:
            break
    return x


def _linear(examples: Examples, use: np.ndarray, bits: int, alpha: float, l2: float, steps: int, least_texts: int, least_ratio: float) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, scores of all texts) of the classifier fitted to those in `use`."""
    ratio, seen = log_count_ratios(examples, use, bits, alpha)
    chosen = np.flatnonzero((seen >= least_texts) & (np.abs(ratio) >= least_ratio))
    column = np.full(1 << bits, -1, dtype=np.int32)
    column[chosen] = np.arange(len(chosen))
    rows, cols, values = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for k, (low, high) in enumerate(zip(examples.begin[:-1], examples.begin[1:])):
        own, counts = column[examples.slots[low:high]], examples.counts[low:high]
        keep = own >= 0
        rows.append(np.full(int(keep.sum()), k, dtype=np.int32))
        cols.append(own[keep])
        values.append((100.0 * counts[keep] / max(1, counts.sum()) * ratio[chosen[own[keep]]]).astype(np.float32))
    row, cols, values = np.concatenate(rows), np.concatenate(cols), np.concatenate(values)
    y = examples.toxic
    weight = np.where(y == 1, 0.5 / max(1, (y[use] == 1).sum()), 0.5 / max(1, (y[use] == 0).sum())) * use
    fitted = use[row]
    own_row, own_cols, own_values = (row, cols, values) if fitted.all() else (row[fitted], cols[fitted], values[fitted])
    parts = [slice(at, at + (1 << 20)) for at in range(0, len(own_row), 1 << 20)]  # temporaries of a part only

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        v, z = x[:-1].astype(np.float32), np.full(len(y), x[-1])
        for p in parts:
            z += np.bincount(own_row[p], own_values[p] * v[own_cols[p]], len(y))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = l2 * (x[:-1] - 1)
        g32 = g.astype(np.float32)
        for p in parts:
            grad += np.bincount(own_cols[p], own_values[p] * g32[own_row[p]], len(chosen))
        value = (weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum() + 0.5 * l2 * ((x[:-1] - 1) ** 2).sum()
        return float(value), np.append(grad, g.sum())

    x = minimise(loss, np.append(np.ones(len(chosen)), 0.0), steps)
    weights = np.zeros(1 << bits, dtype=np.float32)
    weights[chosen] = 100.0 * x[:-1] * ratio[chosen]
    scores, v = np.full(len(y), x[-1]), x[:-1].astype(np.float32)
    for at in range(0, len(row), 1 << 20):
        p = slice(at, at + (1 << 20))
        scores += np.bincount(row[p], values[p] * v[cols[p]], len(y))
    return weights, float(x[-1]), scores


def pick_threshold(scores: np.ndarray, toxic: np.ndarray, most_wrong: float) -> float:
    """The threshold of least error (share of toxic texts missed plus share of others rejected) among those that reject
    at most the share most_wrong of the others; of several the middle one."""
    order = np.argsort(scores)
    zs, ys = scores[order], toxic[order]
    missed = np.concatenate(([0], np.cumsum(ys == 1))) / (ys == 1).sum()
    wrong = 1 - np.concatenate(([0], np.cumsum(ys == 0))) / (ys == 0).sum()
    edges = np.concatenate(([zs[0] - 1], (zs[1:] + zs[:-1]) / 2, [zs[-1] + 1]))
    error = np.where(wrong <= most_wrong + 1e-12, missed + wrong, np.inf)
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(edges[best[len(best) // 2]])


def fit(texts: list[str | None], toxic: list[int], bits: int = 20, alpha: float = 0.3, l2: float = 1e-8, steps: int = 60, folds: int = 4, most_wrong: float = 0.01, least_texts: int = 2, least_ratio: float = 1.5) -> ToxicityModel:
    """A logistic regression on n-gram counts scaled by the log-count ratios, both classes weighing the same. n-grams
    in fewer than least_texts training texts, or with a ratio nearer 0 than least_ratio, are not used.

    The threshold is chosen on scores that each text gets from a model fitted without it: text k is in fold k mod folds
    of its class. So with few labels too all of them count, and at most the share most_wrong of the texts that aren't
    toxic is rejected among them. Without texts of both classes nothing is learnt and nothing rejected; with fewer texts
    of a class than folds the threshold is chosen on the fitted scores."""
    y = np.array(toxic, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(1 << bits, np.float32), 0.0, float("inf"), bits)
    examples = Examples.of(texts, toxic, bits)
    how = (bits, alpha, l2, steps, least_texts, least_ratio)
    weights, bias, scores = _linear(examples, np.ones(len(y), dtype=bool), *how)
    if min((y == 1).sum(), (y == 0).sum()) >= folds:
        fold = np.zeros(len(y), dtype=np.int64)
        for label in (0, 1):
            own = np.flatnonzero(y == label)
            fold[own] = np.arange(len(own)) % folds
        for k in range(folds):
            scores[fold == k] = _linear(examples, fold != k, *how)[2][fold == k]
    return ToxicityModel(weights, bias, pick_threshold(scores, y, most_wrong), bits)


def train(documents: DataFrame, labels: DataFrame, per_class: int = 2500, class_chars: int = 5_000_000, bits: int = 20, seed: str = "nb") -> ToxicityModel:
    """Fits on at most per_class documents of each class, the first by md5(seed, doc_id), less those that would bring
    the class above class_chars characters: fixed bounds on what the driver holds. Texts are used whole.

    A doc_id labelled both ways counts as toxic; labels without doc_id or class are left out, and so are documents
    without a text. Of several texts with one doc_id the least counts. If a class has no text, as in an empty table, the
    model rejects nothing. Other columns, whatever their names, are not read.
    """
    label = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    key = F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string")))
    chosen = [label.where(F.col("y") == y).orderBy(key, "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * per_class rows of an id and a class
    rows = cut(documents.select("doc_id", "text").where("text is not null").join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")))
    sizes = sorted(((hash_key(seed, r.doc_id), str(r.doc_id), r.y, r.n, r.doc_id) for r in rows.select("doc_id", "y", F.length("text").alias("n")).collect()), key=lambda r: r[:2])
    left, used = [class_chars, class_chars], {}
    for *_, y, n, doc_id in sizes:
        if n <= left[y]:
            left[y] -= n
            used[doc_id] = len(used)
    found = [r for r in rows.where(F.length("text") <= class_chars).toLocalIterator() if r.doc_id in used]
    found.sort(key=lambda r: used[r.doc_id])
    return fit([r.text for r in found], [r.y for r in found], bits)


def hash_key(seed: str, value: object) -> str:
    import hashlib

    return hashlib.md5(f"{seed}{value}".encode()).hexdigest()


def score(documents: DataFrame, model: ToxicityModel, name: str = "toxicity") -> DataFrame:
    """documents with a score column (renamed by underscores if taken). Null and empty texts score null.

    Every n-gram of the whole text counts, so the score doesn't depend on how a long text is cut; rows keep all
    their columns, repeated rows get equal scores, and nothing moves between partitions.
    """
    name = fresh(documents.columns, name)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")
    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for at_row in range(0, whole.num_rows, 500):  # few texts at a time are Python strings
                batch = whole.slice(at_row, 500)
                texts = batch.column(at).to_pylist()
                total, count = sums(texts, m.weights, m.bits)
                empty = np.array([not (t and t.strip()) for t in texts], dtype=bool)
                value = np.where(empty, 0.0, total / np.maximum(count, 1) + m.bias)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.float64(), mask=empty)], names=[*batch.schema.names, name])

    return documents.mapInArrow(run, schema)


def keep_clean(documents: DataFrame, model: ToxicityModel, name: str = "toxicity") -> DataFrame:
    """The rows of documents that the model doesn't reject, with their score in a column `name` (with underscores where
    taken). Null and empty texts stay; equal texts get equal scores, so repeated rows stay or go together; a score equal
    to the threshold is rejected; an empty table stays empty."""
    name = fresh(documents.columns, name)
    return score(documents, model, name).where(F.col(name).isNull() | (F.col(name) < model.threshold))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return keep_clean(documents, train(documents, table(spark, sf_dir, "labels")))


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
