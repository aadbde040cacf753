"""Request slots per domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def slots(requests: DataFrame, interval: float, domain: str = "domain", at: str = "arrival", tie: str = "pos", bucket_rows: int = 100_000) -> DataFrame:
    """requests with slot: each starts at its arrival or `interval` after the domain's last slot, whichever is later.

    slot_i = i * interval + max over j <= i of (arrival_j - j * interval): one running maximum and no loop. The maximum
    is taken in spans of time of about bucket_rows requests, if they come evenly; what the spans before bring, their
    counts and maxima, is summed up over one row for each, so a hot domain isn't sorted by one task.
    """
    count, first, last = requests.agg(F.count(F.lit(1)), F.min(at), F.max(at)).first()
    n = max(1, -(-count // bucket_rows))
    span = F.lit(0) if n == 1 or first == last else F.floor((F.col(at) - F.lit(first)) * F.lit(n) / F.lit(last - first)).cast("int")
    step = F.lit(interval)
    within = Window.partitionBy(domain, "_span").orderBy(at, tie)
    rows = requests.withColumn("_span", span).withColumn("_i", F.row_number().over(within))
    rows = rows.withColumn("_m", F.max(F.col(at) - F.col("_i") * step).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    if n == 1:
        return rows.withColumn("slot", F.col("_m") + F.col("_i") * step).drop("_span", "_i", "_m")
    before = Window.partitionBy(domain).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(domain, "_span").agg(F.count(F.lit(1)).alias("_n"), F.max("_m").alias("_most"))
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    spans = spans.withColumn("_high", F.max(F.col("_most") - F.col("_before") * step).over(before)).select(domain, "_span", "_before", "_high")
    rows = rows.join(spans, [domain, "_span"])
    high = F.greatest(F.col("_m") - F.col("_before") * step, F.col("_high"))
    return rows.select(*requests.columns, (high + (F.col("_before") + F.col("_i")) * step).alias("slot"))
