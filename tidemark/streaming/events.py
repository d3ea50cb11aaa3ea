"""Change events, in batch and as streams: ST01-ST12, S14-S17, K06, F12, F13, F17.

Every decision is a column expression or a batch function, so that ``foreachBatch`` and the batch form
share it.  Streams keep their cursor in the query's checkpoint (ST09); sinks are keyed by batch id (ST04).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import clocks, ingress, paths
from tidemark.operators import scans

#: Events as they travel: one JSON object with its type, every other field optional.
EVENT_SCHEMA = "type string, device_id string, rel_path string, hash string, size bigint, vclock map<string,bigint>, manifest_path string, timestamp bigint, merged_vclock map<string,bigint>, old_path string, new_path string, last_seq bigint"
#: Event types that change a path.
MUTATIONS = ["file_synced", "file_deleted", "file_renamed", "conflict_resolved"]


def decode(rows: DataFrame, body: str = "value") -> DataFrame:
    """JSON bodies to event columns; a malformed body gives a null type."""
    return rows.withColumn("_e", F.from_json(F.col(body).cast("string"), EVENT_SCHEMA)).select(*[c for c in rows.columns if c != body], "_e.*")


def encode(events: DataFrame) -> DataFrame:
    """One ``value`` (JSON) and ``subject`` (device and type) a row."""
    return events.select(F.concat_ws(".", F.lit("STATE"), "device_id", "type").alias("subject"), F.to_json(F.struct(*events.columns)).alias("value"))


def accepted(events: DataFrame, own_device: str) -> DataFrame:
    """without own events, and without changes of paths that no configuration lets in (renames name two
    paths and are checked when they are applied)."""
    denied = F.col("type").isin([t for t in MUTATIONS if t != "file_renamed"]) & ingress.fixed_ingress_reason(F.coalesce("rel_path", F.lit(""))).isNotNull()
    return events.where((F.col("device_id") != own_device) & ~denied)


def latest_by_path(events: DataFrame) -> DataFrame:
    """ST02: after replay, each path's event of highest sequence (delivery twice changes nothing)."""
    rest = [c for c in events.columns if c != "rel_path"]
    return events.groupBy("rel_path").agg(F.max_by(F.struct(*rest), "seq").alias("_r")).select("rel_path", *[F.col(f"_r.{c}").alias(c) for c in rest])


def pull_decision(conflict_mode: str = "auto") -> Column:
    """ST03 over columns valid, indexed, is_git, size, size_limit, status, local_hash, cached_hash,
    local_clock, remote_clock, remote_hash, device_id, remote_device: the first rule that holds."""
    same = clocks.outcome(F.col("local_clock"), F.col("remote_clock"), F.coalesce("cached_hash", F.lit("")), F.col("remote_hash"))
    clash = clocks.auto_resolution(F.col("device_id"), F.col("remote_device")) if conflict_mode == "auto" else F.lit("record_conflict")
    return (
        F.when(~F.col("valid"), "drop")
        .when(~F.col("indexed"), "no_ack")
        .when(~F.col("is_git") & (F.col("size") > F.col("size_limit")), "skip_size")
        .when(F.col("status") == "active", "defer")
        .when(F.col("cached_hash").isNotNull() & F.col("local_hash").isNotNull() & (F.col("local_hash") != F.col("cached_hash")), "record_conflict")
        .when(F.col("cached_hash").isNull(), "pull")
        .when(same == "up_to_date", "merge_clocks")
        .when(same == "local_newer", "skip_local_newer")
        .when(same == "remote_newer", "pull")
        .otherwise(clash)
    )


def watch_ignored(path: Column, ignored: list[str] = (".git", "target", "node_modules")) -> Column:
    """placeholders (a bare ``.tc`` has no extension), and paths with an ignored component."""
    return F.rlike(path, F.lit(r"[^/]\.tc$")) | F.arrays_overlap(paths.components(path), F.array(*map(F.lit, ignored)))


def debounce(events: DataFrame, gap_micros: int) -> DataFrame:
    """ST01, batch: events (path, ts_micros, seq, kind) to quiet periods: (path, started, ended, n, kind).

    A period ends once a path is quiet for the gap or longer (exactly the gap ends it too); the last
    kind stays.  Paths are scanned by segments of time, so one with all events spreads over tasks.  Rows without a path
    or a time are left out."""
    kept = events.where("path IS NOT NULL AND ts_micros IS NOT NULL")
    width = max(scans.segment_width(kept, "ts_micros"), gap_micros)
    numbered = scans.numbered_periods(kept, "path", "ts_micros", ["ts_micros", "seq"], gap_micros, width)
    return numbered.groupBy("path", "period").agg(F.min("ts_micros").alias("started"), F.max("ts_micros").alias("ended"), F.count("*").alias("n"), F.max_by("kind", F.struct("ts_micros", "seq")).alias("kind")).drop("period")


def debounce_windows(events: DataFrame, gap: str) -> DataFrame:
    """ST01 with session windows over ``ts`` (batch or stream): one state a path; exactly one gap apart
    joins.  On a stream, set a watermark on ts before (append mode emits a period once it passes)."""
    return events.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max_by("kind", "ts").alias("kind"), F.max("ts").alias("ended")).select("path", F.col("w.start").alias("started"), "ended", "n", "kind")


def retained(log: DataFrame, now: int, max_age: int, newest: int) -> DataFrame:
    """ST08: rows (seq, ts seconds) within the age, and within the newest n by sequence.

    Sequences are unique and without gaps on a log, so the newest n follow from its end."""
    end = log.agg(F.max("seq").alias("_end"))
    return log.crossJoin(F.broadcast(end)).where((F.col("_end") - F.col("seq") < newest) & (F.lit(now) - F.col("ts") <= max_age)).drop("_end")  # one row


def retry_delay(attempt: Column, path: Column, base_ms: int = 1000) -> Column:
    """ST05: base * 2^attempt and up to a quarter more, from the path's length and the attempt."""
    delay = F.lit(base_ms) * F.pow(F.lit(2), attempt).cast("bigint")
    spread = F.floor(delay / 4)
    seed = F.length(path).cast("bigint").bitwiseXOR(attempt.cast("bigint"))
    return delay + F.when(spread > 0, F.pmod(seed * 2654435761, spread)).otherwise(F.lit(0))


def retry_schedule(attempts: DataFrame, most: int = 3) -> DataFrame:
    """ST05: attempts (path, attempt, failed) with what follows: done, retry after ms, or dropped."""
    said = F.when(~F.col("failed"), "done").when(F.col("attempt") >= most, "dropped").otherwise("retry")
    return attempts.withColumn("next", said).withColumn("delay_ms", F.when(said == "retry", retry_delay(F.col("attempt"), F.col("path"))))


def lockout_log(attempts: DataFrame, limit: int = 5, base_seconds: int = 300) -> DataFrame:
    """ST06, batch: rows (device, seq, ok) with failures since the last success and the lockout that the
    row starts: at every ``limit``-th failure in a row, doubling each time."""
    by = Window.partitionBy("device").orderBy("seq")
    runs = attempts.withColumn("_run", F.coalesce(F.sum(F.col("ok").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    in_run = Window.partitionBy("device", "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = runs.withColumn("failures", F.sum((~F.col("ok")).cast("int")).over(in_run)).drop("_run")
    hit = ~F.col("ok") & (F.col("failures") % limit == 0)
    return counted.withColumn("lockout_seconds", F.when(hit, F.lit(base_seconds) * F.pow(F.lit(2), F.col("failures") / limit - 1).cast("bigint")).otherwise(F.lit(0)))


def negative_cache(lookups: DataFrame, ttl: int) -> DataFrame:
    """ST07: lookups (path, ts, found): answered from the cache if the previous miss is younger than ttl."""
    by = Window.partitionBy("path").orderBy("ts", "seq")
    last_miss = F.last(F.when(~F.col("found"), F.col("ts")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return lookups.withColumn("cached_miss", F.coalesce(F.col("ts") - last_miss < ttl, F.lit(False)))


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the files that arrive in a folder; the sink's checkpoint is the durable cursor."""
    return spark.readStream.schema(schema).parquet(path)


def skip_backlog(spark: SparkSession, path: str, schema, checkpoint: str) -> DataFrame:
    """A stream of what arrives from now on.  The cursor in ``checkpoint`` is moved past all that is there,
    without reading it; a query that starts with this checkpoint goes on from that place."""
    stream = stream_table(spark, path, schema)
    run_available(stream, checkpoint, lambda batch, batch_id: None)
    return stream


def run_available(stream: DataFrame, checkpoint: str, per_batch: Callable[[DataFrame, int], None]) -> None:
    """ST11, S16: process what is there, batch by batch, and stop; the checkpoint is the cursor."""
    stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_every(stream: DataFrame, checkpoint: str, per_batch: Callable[[DataFrame, int], None], seconds: int):
    """ST11: process what has arrived each ``seconds``; returns the running query, which the caller stops."""
    return stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def idempotent_writer(out: str) -> Callable[[DataFrame, int], None]:
    """ST04: a batch overwrites its own folder only, so a redelivered batch leaves one copy."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def rate_limit_state(limit: int = 5, base_seconds: int = 300):
    """ST06 as a stateful processor for ``transformWithStateInPandas`` keyed by device: input rows
    (device, ts seconds, ok), output (device, failures, locked_until).

    Rows may come in any order, across chunks and batches: the state holds the last success and the
    failures after it (earlier attempts no longer matter), and the lockout follows from their order by time."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class RateLimit(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.success = handle.getValueState("success", "ts long")
            self.failed = handle.getListState("failed", "ts long")

        def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
            last = self.success.get()[0] if self.success.exists() else None
            failed = np.fromiter((r[0] for r in self.failed.get()), np.int64) if self.failed.exists() else np.zeros(0, np.int64)
            parts = [failed]
            for batch in rows:
                ts, ok = batch["ts"].to_numpy(np.int64), batch["ok"].to_numpy(bool)
                if ok.any():
                    last = int(ts[ok].max()) if last is None else max(last, int(ts[ok].max()))
                parts.append(ts[~ok] if last is None else ts[~ok & (ts > last)])
            failed = np.sort(np.concatenate(parts))
            if last is not None:
                failed = failed[failed > last]
                self.success.update((last,))
            if len(failed):
                self.failed.put([(int(x),) for x in failed])
            else:
                self.failed.clear()
            failures, hits = len(failed), len(failed) // limit
            until = int(failed[hits * limit - 1]) + base_seconds * 2 ** (hits - 1) if hits else 0
            yield pd.DataFrame({"device": [key[0]], "failures": [failures], "locked_until": [until]})

        def close(self) -> None:
            pass

    return RateLimit()
