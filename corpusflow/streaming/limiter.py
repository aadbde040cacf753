"""Request slots per domain over a stream, and the best text so far per address."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusflow.functions.text import completeness


def slots(requests: DataFrame, interval: float) -> DataFrame:
    """(domain, arrival, pos) → (domain, pos, arrival, slot), as operators.schedule.slots over all rows so far,
    provided that a micro-batch brings no arrival before those of earlier ones. State: a domain's last slot."""

    def schedule(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["arrival", "pos"])
        steps = np.arange(len(rows)) * interval
        free = rows["arrival"].to_numpy(dtype=float) - steps
        if len(rows) and last is not None:
            free[0] = max(free[0], last + interval)
        out = np.maximum.accumulate(free) + steps
        if len(rows):
            state.update((float(out[-1]),))
        yield pd.DataFrame({"domain": key[0], "pos": rows["pos"].to_numpy(), "arrival": rows["arrival"].to_numpy(), "slot": out})

    return requests.groupBy("domain").applyInPandasWithState(schedule, "domain string, pos bigint, arrival double, slot double", "last double", "append", GroupStateTimeout.NoTimeout)


def best_texts(readings: DataFrame) -> DataFrame:
    """(url, text) → (url, score, text) whenever a more complete text of an address arrives."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else (-1.0, "")
        rows = pd.concat(list(batches)).sort_values(["score", "text"], ascending=[False, True])
        top = (float(rows["score"].iloc[0]), rows["text"].iloc[0])
        if top[0] > before[0]:
            state.update(top)
            yield pd.DataFrame({"url": [key[0]], "score": [top[0]], "text": [top[1]]})

    scored = readings.select("url", "text", completeness("text").alias("score"))
    return scored.groupBy("url").applyInPandasWithState(keep, "url string, score double, text string", "score double, text string", "update", GroupStateTimeout.NoTimeout)


def admitted(requests: DataFrame, most: int) -> DataFrame:
    """(domain, start, finish, pos) of a batch with in_flight, how many requests of the domain run when it starts, itself
    too, and ok: whether that is within `most`. 0 or less is no limit."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    event = F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d"), "pos"), F.struct(F.col("finish").alias("t"), F.lit(-1).alias("d"), "pos")))
    rows = requests.select("domain", event.alias("e")).select("domain", "e.*")
    running = F.sum("d").over(Window.partitionBy("domain").orderBy("t", "d", "pos").rowsBetween(Window.unboundedPreceding, 0))
    counts = rows.withColumn("in_flight", running).where("d = 1").select("domain", "pos", "in_flight")
    return requests.join(counts, ["domain", "pos"]).withColumn("ok", (F.lit(most) <= 0) | (F.col("in_flight") <= most))
