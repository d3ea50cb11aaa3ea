"""Folder questions over a listing in the order of its components: J10, J13, V07, M01, M05.

With ``/`` read as the least byte, all that lies below a folder follows it at once, as in a pre-order walk of the tree.  One range
sort deals such a listing into parts; what is above or below a path is then a test of the row before or after it, so no
path is multiplied by its depth.  What a part needs of others is one row a part: the nearest key before it or after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.operators.checkpoints import kept

#: Stands for the separator in keys; no path can hold it.
_END = "\x00"


def in_order(rows: DataFrame, path: str = "path") -> DataFrame:
    """Rows with ``_key`` and ``_part``: parts are ranges of keys, numbered in their order.  A table, so parts stay as they are."""
    keyed = rows.withColumn("_key", F.replace(F.col(path), F.lit("/"), F.lit(_END)))
    return kept(keyed.repartitionByRange("_key").withColumn("_part", F.spark_partition_id()), "listing")


def _with_carry(table: DataFrame, value: Column, before: bool, name: str) -> DataFrame:
    """Each row with ``name``: the nearest value that is not null of a row before it (itself not counted), or after it.

    Keys are distinct.  Of other parts only the first or last value counts: one row a part, sorted by one task."""
    order = F.asc("_key") if before else F.desc("_key")
    rows = table.withColumn("_value", value)
    own = F.last("_value", ignorenulls=True).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    edge = (F.max_by if before else F.min_by)("_value", F.when(F.col("_value").isNotNull(), F.col("_key")))
    parts = F.asc("_part") if before else F.desc("_part")
    carry = F.last("_edge", ignorenulls=True).over(Window.orderBy(parts).rowsBetween(Window.unboundedPreceding, -1))
    others = rows.groupBy("_part").agg(edge.alias("_edge")).select("_part", carry.alias("_carry"))
    return rows.withColumn("_own", own).join(F.broadcast(others), "_part").withColumn(name, F.coalesce("_own", "_carry")).drop("_value", "_own", "_carry")  # a row a part


def with_below(rows: DataFrame, counts: Column, path: str = "path") -> DataFrame:
    """Rows of distinct paths with ``has_below``: whether a row that ``counts`` lies below the path."""
    table = in_order(rows.withColumn("_counts", counts), path)
    found = _with_carry(table, F.when(F.col("_counts"), F.col("_key")), False, "_next")
    below = F.coalesce(F.startswith("_next", F.concat("_key", F.lit(_END))), F.lit(False))
    return found.withColumn("has_below", below).drop("_key", "_part", "_counts", "_next")


def folder_claims(files: DataFrame, folded: Column, path: str = "path") -> DataFrame:
    """(claim, role, folded) of every folder of the paths, each once: a path names only those folders that the
    path before it does not lie in.  Folded spellings are cut from the folded path."""
    each = files.where(F.col(path).isNotNull()).groupBy(path).agg(F.first(folded).alias("_folded"))
    table = _with_carry(in_order(each, path), F.col("_key"), True, "_before")
    parts, last = paths.components(F.col(path)), F.split("_before", _END, -1)
    differs = F.array_position(F.zip_with(parts, last, lambda a, b: a.eqNullSafe(b)), F.lit(False))
    common = F.when(F.col("_before").isNull(), 0).otherwise(F.least(differs - 1, F.size(last) - 1)).cast("int")
    both = F.arrays_zip(paths.ancestors(F.col(path)).alias("claim"), paths.ancestors(F.col("_folded")).alias("folded"))
    fresh = F.slice(both, common + 1, F.greatest(F.size(both) - common, F.lit(0)))
    return table.select(F.explode(fresh).alias("c")).select("c.claim", F.lit("directory").alias("role"), "c.folded")


def nearest_above(files: DataFrame, marks: DataFrame, path: str = "path", folder: str = "folder") -> DataFrame:
    """(path, mark): of each distinct path the row of ``marks`` whose folder is the path or its nearest ancestor; paths
    without one are left out.

    Folders of one depth do not overlap, so at each depth only the last one before a path can hold it: a window
    column a depth, and the deepest that holds it counts."""
    depth = F.size(F.split(folder, "/", -1))
    depths = sorted(r[0] for r in marks.where(F.col(folder).isNotNull()).select(depth).distinct().collect())  # few: depths of folders
    mark = F.struct(*marks.columns)
    side = marks.where(F.col(folder).isNotNull()).select(F.col(folder).alias(path), mark.alias("_mark"), depth.alias("_depth"), F.lit(0).alias("_kind"))
    wanted = files.where(F.col(path).isNotNull()).select(path).distinct()
    rows = side.unionByName(wanted.select(path, F.lit(None).cast(side.schema["_mark"].dataType).alias("_mark"), F.lit(0).alias("_depth"), F.lit(1).alias("_kind")))
    table = in_order(rows, path)
    by = Window.partitionBy("_part").orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda d: F.when(F.col("_depth") == d, F.col("_mark"))
    others = table.groupBy("_part").agg(*(F.max_by(at(d), F.when(F.col("_depth") == d, F.col("_key"))).alias(f"_e{d}") for d in depths), F.lit(0).alias("_"))
    others = others.select("_part", *(F.last(f"_e{d}", ignorenulls=True).over(before).alias(f"_e{d}") for d in depths))
    seen = table.select("*", *(F.last(at(d), ignorenulls=True).over(by).alias(f"_m{d}") for d in depths)).join(F.broadcast(others), "_part")  # a row a part

    def holds(d: int) -> Column:
        m = F.coalesce(f"_m{d}", f"_e{d}")
        key = F.replace(m[folder], F.lit("/"), F.lit(_END))
        return F.when((F.col("_key") == key) | F.startswith("_key", F.concat(key, F.lit(_END))), m)

    best = F.coalesce(*(holds(d) for d in reversed(depths))) if depths else F.lit(None).cast(side.schema["_mark"].dataType)
    return seen.where("_kind = 1").select(path, best.alias("mark")).where("mark IS NOT NULL")
