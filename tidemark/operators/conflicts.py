"""Conflict ledger, groups, listing and resolution: ST12, A02-A04, T02, C11."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths

STATUSES = ["not_synced", "synced", "active", "locked", "conflict"]


def ledger(cycles: DataFrame) -> DataFrame:
    """ST12 over recorded cycles (rel_path, cycle, detected_at): first detection, times, latest cycle."""
    return cycles.groupBy("rel_path").agg(F.min_by("detected_at", "cycle").alias("detected_at"), F.count("*").alias("times_recorded"), F.max("cycle").alias("last_cycle"))


def upsert(held: DataFrame, found: DataFrame) -> DataFrame:
    """ST12, one cycle: a known conflict counts once more and keeps its first detection; a new one starts at 1."""
    h = held.select("rel_path", F.col("detected_at").alias("_first"), F.col("times_recorded").alias("_times"))
    both = h.join(found.select("rel_path", F.col("detected_at").alias("_now")), "rel_path", "full_outer")
    times = F.coalesce("_times", F.lit(0)) + F.when(F.col("_now").isNotNull(), 1).otherwise(0)
    return both.select("rel_path", F.coalesce("_first", "_now").alias("detected_at"), times.alias("times_recorded"), F.lit("conflict").alias("status"))


def groups(items: DataFrame) -> DataFrame:
    """Conflicts (rel_path, ...) by enclosing repository: a row a path, (repo_root, rel_path), in order of
    both; the flat group (null) is last.  A range sort, so no group is gathered anywhere."""
    return items.select(paths.repo_root(F.col("rel_path")).alias("repo_root"), "rel_path").distinct().orderBy(F.col("repo_root").asc_nulls_last(), "rel_path")


def group_counts(items: DataFrame) -> DataFrame:
    """A04 by group, without lists: n, branch heads, first and last path."""
    rows = items.withColumn("repo_root", paths.repo_root(F.col("rel_path")))
    return rows.groupBy("repo_root").agg(F.count("*").alias("n"), F.count(paths.head_ref(F.col("rel_path"))).alias("heads"), F.min("rel_path").alias("first_path"), F.max("rel_path").alias("last_path"))


def listing(items: DataFrame) -> DataFrame:
    """T02"""
    return items.orderBy("rel_path", "cache_key")


def status_counts(state: DataFrame) -> DataFrame:
    """Total and five exclusive counts, with the rows whose status and conflict disagree."""
    return state.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count_if((F.col("status") == "conflict") != F.col("conflict").isNotNull()).alias("inconsistent"))


def diagnostics(state: DataFrame, now: int, max_age: int) -> DataFrame:
    """Entries, conflicts, and those old enough to unsync (not exempt)."""
    return state.agg(F.count("*").alias("entries"), F.count("conflict").alias("conflicts"), F.count_if((F.lit(now) - F.col("last_synced") > max_age) & ~F.col("exempt")).alias("unsync_eligible"))


def resolution(strategy: Column, is_git: Column, may_pull: Column, may_push: Column, strict: bool = True) -> Column:
    """C11: struct(accepted, reason).  Strict mode refuses what the original refuses: only ``defer`` and
    keep_both of a repository are accepted, and the latter needs both permissions."""
    says = lambda ok, why: F.struct(F.lit(ok).alias("accepted"), F.lit(why).alias("reason"))
    out = F.when(~strategy.isin("keep_local", "keep_remote", "keep_both", "defer"), says(False, "unknown strategy")).when(strategy == "defer", says(True, "no change"))
    if strict:
        out = out.when(~is_git | (strategy != "keep_both"), says(False, "refused per file"))
        return out.when(~(may_pull & may_push), says(False, "needs pull and push")).otherwise(says(True, "park remote heads"))
    return out.when((strategy == "keep_remote") & ~may_pull, says(False, "needs pull")).when((strategy == "keep_local") & ~may_push, says(False, "needs push")).when((strategy == "keep_both") & ~(may_pull & may_push), says(False, "needs pull and push")).otherwise(says(True, "planned"))
