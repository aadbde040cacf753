"""Packing by non-negative least squares on the histogram of lengths."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import hash60, ranked, table, unit

SEPARATOR = "\n"


def strategies(bins: int, depth: int = 3) -> list[tuple[int, ...]]:
    """All multisets of at most depth bins, largest first, whose sizes add up to exactly bins."""
    found: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            found.append(chosen)
        elif len(chosen) < depth:
            for size in range(min(left, most), 0, -1):
                if size * (depth - len(chosen)) >= left:
                    extend((*chosen, size), left - size, size)

    extend((), bins, bins)
    return found


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 3000) -> np.ndarray:
    """argmin |a x - b| over x >= 0, by Lawson and Hanson's active sets; only the active columns' normal equations are
    formed, so memory stays at that of a."""
    x = np.zeros(a.shape[1])
    used: list[int] = []
    tolerance = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0.0))
    for _ in range(steps):
        w = a.T @ (b - a[:, used] @ x[used])
        w[used] = -np.inf
        j = int(np.argmax(w))
        if not w[j] > tolerance:
            break
        used.append(j)
        while True:
            own = a[:, used]
            square = own.T @ own
            z = np.linalg.solve(square + np.eye(len(used)) * (1e-11 * max(1e-30, np.trace(square) / len(used))), own.T @ b)
            if z.min() > 0:
                break
            bad = z <= 0
            current = x[used]
            alpha = np.min(current[bad] / np.maximum(current[bad] - z[bad], 1e-300))
            moved = current + alpha * (z - current)
            drop = (moved <= 1e-12 * max(1e-30, moved.max())) | (bad & (moved <= moved[bad].min()))
            x[used] = np.where(drop, 0, moved)
            used = [k for k, d in zip(used, drop) if not d]
            if not used:
                break
        x[used] = z if used else []
    return x


@dataclass(frozen=True)
class Plan:
    """rows: (bin, first, last, base): the pieces ranked first..last within a bin go to the packs base+0, base+1, ..."""

    rows: list[tuple[int, int, int, int]]
    packs: int


def plan(histogram: np.ndarray, depth: int = 3) -> Plan:
    """histogram[k]: how many pieces take k+1 of len(histogram) units. Every piece gets one place; a pack's pieces take
    at most all units. Costs depend on the number of bins and not on the counts."""
    bins = len(histogram)
    left = histogram.astype(np.int64).copy()
    combos = strategies(bins, depth)
    chosen: list[tuple[tuple[int, ...], int]] = []
    if left.sum():
        a = np.zeros((bins, len(combos)))
        for j, combo in enumerate(combos):
            for size in combo:
                a[size - 1, j] += 1
        weight = np.sqrt(1.0 / np.maximum(left, 1))  # relative errors, lest a few frequent lengths decide
        x = nnls(a * weight[:, None], left * weight)
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            need = np.bincount(np.array(combos[j]) - 1, minlength=bins)
            times = int(min(round(x[j]), (left[need > 0] // need[need > 0]).min()))
            if times:
                chosen.append((combos[j], times))
                left -= times * need
    while left.any():  # what remains: the largest with the largest that still fit, as often as that goes
        rest, room, combo = left.copy(), bins, []
        while room and (fits := np.flatnonzero(rest[:room])).size:
            combo.append(int(fits[-1]) + 1)
            rest[fits[-1]] -= 1
            room -= fits[-1] + 1
        need = np.bincount(np.array(combo) - 1, minlength=bins)
        times = int((left[need > 0] // need[need > 0]).min())
        chosen.append((tuple(combo), times))
        left -= times * need
    rows, base, taken = [], 0, np.zeros(bins, dtype=np.int64)
    for combo, times in chosen:
        for size in combo:
            rows.append((size, int(taken[size - 1]) + 1, int(taken[size - 1]) + times, base))
            taken[size - 1] += times
        base += times
    return Plan(rows, base)


def pack(documents: DataFrame, window: int = 8192, bins: int = 256, depth: int = 3, seed: int = 1) -> DataFrame:
    """One row per pack: pack_id, doc_ids, starts, lengths, used and text.

    Lengths are counted in characters: a piece takes its own and one for the separator after it. Texts longer than
    window - 1 are cut into whole windows and a remainder, so every character of every text is in exactly one piece
    (start counts from 0). Pieces are counted in `bins` equal steps of length; combinations of at most `depth` steps
    that fill a window are solved for by NNLS against the histogram, rounded, and the residuals packed greedily.
    The same pieces always give the same packs, whatever the partitions: within a length, pieces are ranked by a seeded
    hash. used is the number of characters with separators, at most window.

    Null and empty texts are left out. A null doc_id is carried as null; doc_id keeps its type, which must be one that
    can be ordered. Repeated rows are packed each. Other columns are not read. The result for an empty table is empty.

    Only the histogram reaches the driver. The plan is some hundred rows whatever the input, so it is broadcast;
    texts move twice, to be ranked within a length (hot lengths are spread over buckets of about 16 MB) and to their
    packs. The scans that count lengths cut no text: a piece's length follows from its text's.
    """
    if window % bins or bins < 1:
        raise ValueError("window must be a multiple of bins")
    step, body = window // bins, window - 1
    texts = documents.where(F.length("text") > 0).select("doc_id", "text", F.length("text").alias("n"), F.xxhash64("text").alias("h"))
    last = F.floor((F.col("n") - 1) / body).cast("int")
    length = F.least(F.lit(body), F.col("n") - F.col("k") * body).cast("int").alias("length")
    at = unit(hash60(F.lit(seed), "doc_id", "h", "k")).alias("at")
    sized = texts.select("doc_id", "n", "h", F.explode(F.sequence(F.lit(0), last)).alias("k")).select(length, at).withColumn("bin", F.ceil((F.col("length") + 1) / step).cast("int"))
    found = sized.groupBy("bin").agg(F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("chars")).collect()  # at most `bins` rows
    counts = {r.bin: r.pieces for r in found}
    made = plan(np.array([counts.get(b, 0) for b in range(1, bins + 1)]), depth)
    spark = documents.sparkSession
    places = F.broadcast(spark.createDataFrame(made.rows or [(0, 1, 0, 0)], "slot_bin int, first bigint, last bigint, base bigint"))
    # a regular expression cuts a long text in one pass; substring() would walk from its start for each piece
    parts = F.when(F.col("n") <= body, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{body}}}"), F.lit(0)))
    pieces = texts.select("doc_id", "n", "h", F.posexplode(parts).alias("k", "text")).select("doc_id", (F.col("k") * body).alias("start"), "text", length, at)
    pieces = pieces.withColumn("bin", F.ceil((F.col("length") + 1) / step).cast("int"))
    total = sum(counts.values())
    mean = sum(r.chars for r in found) / max(1, total)
    numbered = ranked(pieces, ["bin"], "at", [F.col("doc_id").asc_nulls_last(), F.col("start"), F.col("text")], "rank", total, bucket_rows=int(max(500, (16 << 20) / max(mean, 100))), narrow=sized)
    placed = numbered.join(places, (F.col("bin") == F.col("slot_bin")) & F.col("rank").between(F.col("first"), F.col("last")))
    packs = placed.groupBy((F.col("base") + F.col("rank") - F.col("first")).alias("pack_id")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("n"), F.col("doc_id").isNull().alias("u"), "doc_id", "start", "text"))).alias("p")
    )
    return packs.select(
        "pack_id",
        F.col("p.doc_id").alias("doc_ids"),
        F.col("p.start").alias("starts"),
        F.transform("p", lambda x: -x["n"]).alias("lengths"),
        F.aggregate("p", F.lit(0), lambda s, x: s - x["n"] + 1).alias("used"),
        F.array_join("p.text", SEPARATOR).alias("text"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
SQL: dict[str, str] = {}
