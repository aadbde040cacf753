"""Image frames: difference hashes and duplicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dhash(pixels: Column, width: int = 8) -> Column:
    """A bit for every pixel that is darker than its right neighbour, row by row, the first the highest. pixels: rows
    of `width` values; 9 wide and 8 high gives 64 bits."""
    n = F.size(pixels)
    places = F.filter(F.sequence(F.lit(0), n - 2), lambda i: i % width != width - 1)
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda h, i: F.shiftleft(h, 1).bitwiseOR((F.get(pixels, i) < F.get(pixels, i + 1)).cast("bigint")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def drop_repeats(frames: DataFrame, most: int = 10) -> DataFrame:
    """(key, pos, hash): frames that differ from the one before, kept or not, in over `most` bits."""
    before = F.lag("hash").over(Window.partitionBy("key").orderBy("pos"))
    return frames.withColumn("_b", before).where(F.col("_b").isNull() | (hamming(F.col("hash"), F.col("_b")) > most)).drop("_b")


def drop_similar(frames: DataFrame, near: float = 5.0, share: float = 0.95) -> DataFrame:
    """(key, pos, pixels) → (key, pos): greedily, in order, frames that are like none kept before: no kept frame has
    over `share` of its pixels within `near`. The choice depends on earlier choices, so it runs per key in Python."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        kept: list[np.ndarray] = []
        rows = []
        for pos, pixels in zip(group["pos"], group["pixels"]):
            x = np.asarray(pixels, dtype=np.float64)
            if not any(len(k) == len(x) and (np.abs(k - x) < near).mean() > share for k in kept):
                kept.append(x)
                rows.append(pos)
        return pd.DataFrame({"key": group["key"].iloc[0], "pos": rows})

    return frames.select("key", "pos", "pixels").groupBy("key").applyInPandas(choose, "key bigint, pos bigint")
