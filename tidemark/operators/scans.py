"""Ordered scans of keys that may hold most rows: W02, ST01.

A key's rows are cut by an ordered number into segments.  Each segment is summarised, the few summaries of a key are scanned
in order, and what a segment needs from those before it comes back to its rows.  Sorting and numbering thus happen a segment at a time,
so a key with all rows spreads over as many tasks as it has segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a segment holds about, where the rows of a key lie evenly.
SEGMENT_ROWS = 1 << 15


def segment_width(rows: DataFrame, at: str, most: int = SEGMENT_ROWS) -> int:
    """How wide segments are in the unit of ``at``: all rows' span by the segments that they would fill."""
    low, high, n = rows.agg(F.min(at), F.max(at), F.count("*")).first()
    return max(1, -(-(high - low + 1) // max(1, n // most))) if n and low is not None else 1


def prefix_sums(rows: DataFrame, key: str, at: str, sums: dict[str, str], width: int = SEGMENT_ROWS) -> DataFrame:
    """Rows with the sums (new column: summed column) of all rows of their key at smaller ``at`` (whole numbers, distinct
    within a key; null keys are one key)."""
    cut = rows.withColumn("_segment", F.floor(F.col(at) / width))
    earlier = Window.partitionBy(key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(key, "_segment").agg(*(F.sum(c).alias(f"_{c}") for c in set(sums.values())))
    base = totals.select(F.col(key).alias("_key"), F.col("_segment").alias("_at"), *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in set(sums.values())))
    within = Window.partitionBy(key, "_segment").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumns({f"_own_{name}": F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in sums.items()})
    met = own.join(base, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_segment") == F.col("_at")))
    return met.select(*rows.columns, *((F.col(f"_own_{name}") + F.col(f"_{c}")).alias(name) for name, c in sums.items()))


def numbered_periods(rows: DataFrame, key: str, at: str, order: list[str], gap: int, width: int) -> DataFrame:
    """Rows with ``period``: the number of their key's quiet periods so far; one ends where ``at`` is ``gap`` or more after the row before.

    A segment's first row needs the last ``at`` before it, and all its rows the number of periods that began before it:
    both follow from (first, last, breaks inside) of the key's segments in order."""
    cut = rows.withColumn("_segment", F.floor(F.col(at) / width))
    within = Window.partitionBy(key, "_segment").orderBy(*order)
    apart = (F.col(at) - F.lag(at).over(within) >= gap).cast("int")  # null for a segment's first row
    marked = cut.withColumn("_new", F.coalesce(apart, F.lit(0))).withColumn("_breaks", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    each = cut.groupBy(key, "_segment").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    inside = marked.groupBy(key, "_segment").agg(F.sum("_new").alias("_inside"))
    segments = each.join(inside, [key, "_segment"])
    by: Window = Window.partitionBy(key).orderBy("_segment")
    opens: Column = F.coalesce((F.col("_first") - F.lag("_last").over(by) >= gap).cast("int"), F.lit(1))
    opened = segments.withColumn("_opens", opens).withColumn("_total", F.sum(F.col("_opens") + F.col("_inside")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    base = opened.select(key, "_segment", (F.col("_total") - F.col("_inside")).alias("_base"))
    return marked.join(base, [key, "_segment"]).withColumn("period", F.col("_base") + F.col("_breaks")).select(*rows.columns, "period")
