"""Counters, histograms, summaries and budgets: A06, A09-A16, A18, A20, T04, T11, T12, S20."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import paths

#: Upper bounds of the duration histogram, in seconds.
BUCKETS = [0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 120.0]


def cache_stats(entries: DataFrame) -> DataFrame:
    """Bytes, entries and shards of cache rows (key, size)."""
    return entries.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"), F.count("*").alias("entry_count"), F.count_distinct(paths.shard(F.col("key"))).alias("shard_count"))


def execution_result(outcomes: DataFrame) -> DataFrame:
    """Counts and bytes of outcome rows (action, outcome, bytes)."""
    n = lambda a: F.count_if((F.col("action") == a) & (F.col("outcome") == "ok"))
    return outcomes.agg(n("push").alias("pushed"), n("pull").alias("pulled"), F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.count_if(F.col("outcome") == "error").alias("errors"), F.coalesce(F.sum(F.when(F.col("outcome") == "ok", F.col("bytes"))), F.lit(0)).cast("long").alias("bytes"))


def roll_call(devices: DataFrame) -> DataFrame:
    """Active and capable devices (name, revoked, capable), and the names of the incapable."""
    active = devices.where("NOT revoked")
    return active.agg(F.count("*").alias("active"), F.count_if("capable").alias("capable"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("capable"), F.col("name")))), ",").alias("incapable"))


def counters(events: DataFrame, *by: str) -> DataFrame:
    """Monotonic counters by label; the same on a stream in complete or update mode."""
    return events.groupBy(*by).agg(F.count("*").alias("n"))


def histogram(tasks: DataFrame, label: str, seconds: str, buckets: list[float] = BUCKETS) -> DataFrame:
    """Cumulative counts (label, le, n) with le = +Inf for all; one conditional aggregation."""
    counts = [F.count_if(F.col(seconds) <= b).alias(f"_{i}") for i, b in enumerate(buckets)]
    per = tasks.groupBy(label).agg(*counts, F.count("*").alias(f"_{len(buckets)}"))
    rows = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate([*buckets, "+Inf"])])
    return per.select(label, F.explode(rows).alias("r")).select(label, "r.le", "r.n")


def push_summary(log: DataFrame) -> DataFrame:
    """One row over push-log lines (seq, ts, path, chunks, bytes, uploaded_bytes, elapsed_ms, flag,
    concurrency): counts, sums, tri-state flag counts, bytes not uploaded, the few distinct concurrency values,
    subtotals of packs and pack indexes, first and last time, and the path of each maximum (first seen wins)."""
    first_max = lambda c: F.max_by("path", F.struct(c, -F.col("seq")))
    of = lambda suffix, name: [F.count_if(F.endswith("path", F.lit(suffix))).alias(f"{name}_rows"), *[F.coalesce(F.sum(F.when(F.endswith("path", F.lit(suffix)), F.col(c))), F.lit(0)).cast("long").alias(f"{name}_{c}") for c in ("chunks", "bytes")]]
    return log.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("flag") == "true").alias("flag_true"),
        F.count_if(F.col("flag") == "false").alias("flag_false"),
        F.count_if(F.col("flag").isNull()).alias("flag_absent"),
        F.sum("chunks").cast("long").alias("chunks"),
        F.sum("bytes").cast("long").alias("bytes"),
        F.sum(F.greatest(F.col("bytes") - F.col("uploaded_bytes"), F.lit(0))).cast("long").alias("bytes_not_uploaded"),
        F.array_join(F.array_sort(F.collect_set("concurrency")).cast("array<string>"), ",").alias("concurrency"),
        *of(".pack", "pack"),
        *of(".idx", "pack_index"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        first_max("chunks").alias("most_chunks"),
        first_max("bytes").alias("most_bytes"),
        first_max("elapsed_ms").alias("slowest"),
    )


def push_totals(files: DataFrame) -> DataFrame:
    """A10: one row over pushed files (chunks, bytes, uploaded_bytes): uploaded, skipped, chunks and bytes."""
    sent = F.col("uploaded_bytes") > 0
    total = lambda c: F.coalesce(F.sum(F.when(sent, F.col(c))), F.lit(0)).cast("long")
    return files.agg(F.count_if(sent).alias("uploaded"), F.count_if(~sent).alias("skipped"), total("chunks").alias("chunks"), total("bytes").alias("bytes"), total("uploaded_bytes").alias("uploaded_bytes"))


def parse_push_line(line: Column) -> Column:
    """``key=value`` fields of one log line as a map."""
    return F.str_to_map(F.regexp_replace(line, r"^\S+ ", ""), F.lit(" "), F.lit("="))


def decision_counts(rows: DataFrame) -> DataFrame:
    """Rows by decision and by reason in one pass (grouping sets), NULL where not grouped."""
    return rows.groupingSets([[F.col("decision")], [F.col("reason")]], "decision", "reason").agg(F.count("*").alias("n"))


def slo(observed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(metric, value, budget, verdict) of observed (metric, value); a budget of 0 or none only observes."""
    joined = observed.join(budgets, "metric", "left")
    budget = F.coalesce("budget", F.lit(0))
    return joined.select("metric", "value", budget.alias("budget"), F.when(budget == 0, "observe").when(F.col("value") <= budget, "ok").otherwise("over").alias("verdict"))


def rate(units: Column, seconds: Column) -> Column:
    """Units a second; 0 where no time passed."""
    return F.when(seconds > 1e-9, units / seconds).otherwise(F.lit(0.0))


def lockouts(attempts: DataFrame, limit: int = 5) -> DataFrame:
    """(device, failures, locked) since the last success of attempts (device, seq, ok)."""
    last_ok = Window.partitionBy("device")
    since = attempts.withColumn("_ok", F.max(F.when(F.col("ok"), F.col("seq"))).over(last_ok))
    per = since.groupBy("device").agg(F.count_if(~F.col("ok") & (F.col("seq") > F.coalesce("_ok", F.lit(-1)))).alias("failures"))
    return per.withColumn("locked", F.col("failures") >= limit)


def queue_order(tasks: DataFrame) -> DataFrame:
    """Highest priority first, then oldest."""
    return tasks.orderBy(F.col("priority").desc(), "created_at", "path")


def last_samples(samples: DataFrame, key: str, n: int) -> DataFrame:
    """The newest n rows of each key by seq."""
    return samples.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("seq").desc()))).where(F.col("_n") <= n).drop("_n")


def inventory_counts(files: DataFrame) -> DataFrame:
    """One row over tree rows (kind, size, fault)."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return files.agg(n("file").alias("files"), n("directory").alias("directories"), n("symlink").alias("symlinks"), F.count("fault").alias("faults"), F.coalesce(F.sum(F.when(F.col("kind") == "file", F.col("size"))), F.lit(0)).cast("long").alias("bytes"))
