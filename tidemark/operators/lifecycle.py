"""Sweeps, eviction, trash and file mutations: L01-L03, L05, L08-L13, L18, F11, F14, M03-M08, T05-T08, W01, W03."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import clocks, paths
from tidemark.operators import checkpoints
from tidemark.operators import folders as tree


def pressured_age(max_age: int, used: int, total: int, threshold: float) -> int:
    """Half the age at or above the threshold of use; a threshold of 0 never does."""
    return max_age // 2 if threshold > 0 and total > 0 and used / total >= threshold else max_age


def tag_sweep(entries: DataFrame, now: int, max_age: int) -> DataFrame:
    """Entries (path, last_synced, size, exempt, on_disk, dirty) with the first rule that holds:
    young, exempt, missing, dirty, unsync.  Future times count as age 0."""
    age = F.greatest(F.lit(now) - F.col("last_synced"), F.lit(0))
    tag = F.when(age <= max_age, "young").when(F.col("exempt"), "exempt").when(~F.col("on_disk"), "missing").when(F.col("dirty"), "dirty").otherwise("unsync")
    return entries.withColumn("outcome", tag)


def sweep_report(tagged: DataFrame) -> DataFrame:
    """One row of counters."""
    n = lambda name: F.count_if(F.col("outcome") == name)
    return tagged.agg(F.count("*").alias("scanned"), n("unsync").alias("unsynced"), n("exempt").alias("skipped_exempt"), n("dirty").alias("skipped_dirty"), n("missing").alias("skipped_missing"), F.coalesce(F.sum(F.when(F.col("outcome") == "unsync", F.col("size"))), F.lit(0)).cast("long").alias("bytes_reclaimed"))


def bounded_sweep(tagged: DataFrame, most: int) -> DataFrame:
    """The first ``most`` unsyncable entries, oldest first; 0 means all."""
    ready = tagged.where("outcome = 'unsync'")
    return ready.orderBy("last_synced", "path").limit(most) if most else ready


#: Entries that one range of an eviction's order holds on average.
ENTRIES_A_RANGE = 1_000_000


def evict(entries: DataFrame, max_bytes: int, group: str | None = None, ranges: int | None = None) -> DataFrame:
    """Entries (key, size, mtime) to evict, oldest first (then by key), until the rest fits.

    An entry goes if the total less all older entries still exceeds the limit, of all entries or of its
    ``group`` (a column that tells caches apart).  Older bytes are a running sum in two steps: entries are
    dealt by ranges of the whole order, so equal times and large groups are split too, and a range adds the
    bytes of the ranges before it.  The ranges are checkpointed, since both steps must see the same ones;
    without ``ranges`` their number follows from the entries."""
    checkpoints.ensure(entries.sparkSession)
    if ranges is None:
        ranges = max(1, -(-entries.count() // ENTRIES_A_RANGE))
    by = [F.col(group)] if group is not None else []
    placed = entries.repartitionByRange(ranges, *by, F.col("mtime"), F.col("key")).withColumn("_range", F.spark_partition_id()).checkpoint()
    sums = placed.groupBy(*by, "_range").agg(F.sum("size").alias("_bytes"))  # a row a group and range
    before = F.coalesce(F.sum("_bytes").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[c.alias("_group") for c in by], F.col("_range").alias("_of"), before.alias("_before"), F.sum("_bytes").over(Window.partitionBy(*by)).alias("_total"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy(*by, "_range").orderBy("mtime", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("_range") == F.col("_of")
    for c in by:
        same = same & c.eqNullSafe(F.col("_group"))
    return placed.withColumn("_inside", inside).join(sums, same).where(F.col("_total") - F.col("_before") - F.col("_inside") > max_bytes).select(*entries.columns)


def latest(rows: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    """The newest row of each key (row_number, so extra columns stay together)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*newest_first))).where("_n = 1").drop("_n")


def trash_listing(trash: DataFrame) -> DataFrame:
    """Newest first, then by key from the end."""
    return trash.orderBy(F.col("trashed_at").desc(), F.col("trash_key").desc())


def trash_select(trash: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, trash_key, outcome): exactly one generation of a path is ok."""
    per = trash.groupBy("path").agg(F.count("*").alias("n"), F.min("trash_key").alias("only"))
    joined = wanted.join(per, "path", "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select("path", F.when(n == 1, F.col("only")).alias("trash_key"), F.when(n == 1, "ok").when(n > 1, "ambiguous").otherwise("missing").alias("outcome"))


def trash_purge(trash: DataFrame, now: int, max_age: int) -> DataFrame:
    """Outcome of each generation (trashed_at epoch seconds or null): purge, keep or retained
    (age unknown).  max_age 0 purges all of known age."""
    age = F.lit(now) - F.col("trashed_at")
    return trash.withColumn("outcome", F.when(F.col("trashed_at").isNull(), "retained").when(F.lit(max_age == 0) | (age > max_age), "purge").otherwise("keep"))


def trash_restore(trash: DataFrame, index: DataFrame) -> DataFrame:
    """Restore only where the destination is absent, deleted or the same content."""
    i = index.select("path", F.col("hash").alias("_now"), F.col("state").alias("_state"))
    joined = trash.join(i, "path", "left")
    return joined.select("path", "trash_key", F.when(F.col("_state").isNull(), "restore").when(F.col("_state") == "deleted", "restore").when(F.col("_now") == F.col("hash"), "identical").otherwise("destination_conflict").alias("outcome"))


def unsync_plan(targets: DataFrame, force: bool = False) -> DataFrame:
    """Targets (path, kind, dirty, on_disk, stub): the outcome of each row."""
    said = F.when(F.col("kind") == "directory", "skip").when(F.col("dirty") & F.lit(not force), "dirty").when(F.col("on_disk") & (F.col("kind") != "file"), "skip").when(~F.col("on_disk") & F.col("stub"), "already stubbed").when(~F.col("on_disk"), "hydrated file missing").otherwise("unsync")
    return targets.withColumn("outcome", said)


def directory_unsync(plan: DataFrame, folder: str) -> DataFrame:
    """L10 for a folder: its rows in order; one dirty row aborts them all."""
    rows = plan.where(F.startswith("path", F.lit(f"{folder}/")))
    aborted = rows.agg(F.coalesce(F.bool_or(F.col("outcome") == "dirty"), F.lit(False)).alias("aborted"))
    return rows.crossJoin(F.broadcast(aborted)).withColumn("outcome", F.when(F.col("aborted"), "aborted").otherwise(F.col("outcome"))).drop("aborted")  # one row


def stale(state: DataFrame, prefix: str) -> DataFrame:
    """rows that a purge drops: no conflict, and a remote path outside the prefix (its last slashes do not count) or a
    vanished path below /tmp or /private/tmp."""
    outside = ~F.startswith("remote_path", F.lit(f"{prefix.rstrip('/')}/"))
    temporary = F.startswith("path", F.lit("/tmp/")) | F.startswith("path", F.lit("/private/tmp/"))
    return state.where(F.col("conflict").isNull() & (outside | (temporary & ~F.col("on_disk"))))


def conflicts(state: DataFrame) -> DataFrame:
    """F11"""
    return state.where(F.col("conflict").isNotNull())


def dehydrate(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (path, key): bytes freed and whether the content was cached."""
    joined = wanted.join(cache.select("key", "size"), "key", "left")
    return joined.select("path", F.coalesce("size", F.lit(0)).alias("bytes_freed"), F.col("size").isNotNull().alias("was_cached"))


def rotation_scan(manifests: DataFrame, old_key: str, new_key: str, after: str | None = None) -> DataFrame:
    """Outcome of each manifest (path, key_id, per_device) past the resume point."""
    rows = manifests if after is None else manifests.where(F.col("path") > after)
    said = F.when(F.col("per_device"), "skipped_per_device").when(F.col("key_id").isNull(), "skipped_keyless").when(F.col("key_id") == new_key, "already_rotated").when(F.col("key_id") == old_key, "rotated").otherwise("error")
    return rows.withColumn("outcome", said)


def rotation_report(scan: DataFrame) -> DataFrame:
    """Counts, the last path, and whether the keys may be swapped (no error)."""
    n = lambda name: F.count_if(F.col("outcome") == name)
    return scan.agg(*[n(x).alias(x) for x in ("rotated", "already_rotated", "skipped_keyless", "skipped_per_device", "error")], F.max("path").alias("last_path")).withColumn("status", F.when(F.col("error") > 0, "incomplete").otherwise("ready_to_swap"))


def safe_prefix(prefix: Column) -> Column:
    """a permission prefix without outer slashes; null if it is empty, has an empty, ``.`` or ``..`` component, a
    backslash or a control character."""
    clean = F.regexp_replace(prefix, "^/+|/+$", "")
    unsafe = (clean == "") | clean.rlike(r"[\\\p{Cc}]") | F.exists(F.split(clean, "/", -1), lambda c: c.isin("", ".", ".."))
    return F.when(~unsafe, clean)


def live_sessions(sessions: DataFrame, now: int, prefix: str | None = None) -> DataFrame:
    """Sessions (expires_at, revoked, prefixes) that hold, and may use a prefix.

    One without an expiry never ends, and one that expires now still holds.  No prefix in the list allows all; an unsafe
    prefix, wanted or listed, allows nothing."""
    held = sessions.where((F.col("expires_at").isNull() | (F.col("expires_at") >= now)) & ~F.col("revoked"))
    if prefix is None:
        return held
    wanted = safe_prefix(F.lit(prefix))
    allowed = F.exists("prefixes", lambda p: F.coalesce((wanted == safe_prefix(p)) | F.startswith(wanted, F.concat(safe_prefix(p), F.lit("/"))), F.lit(False)))
    return held.where((F.size("prefixes") == 0) | allowed)


def keep_both(group: DataFrame) -> DataFrame:
    """L13, plan only: conflicting git paths (rel_path, local_sha, remote_sha, local_clock, remote_clock)
    of repositories: parked branch heads, kept local files, vetoes and the merged clock."""
    rel, head = F.col("rel_path"), paths.head_ref(F.col("rel_path"))
    local_only = rel.rlike(r"\.git/(index|HEAD|logs/.*)$")
    said = F.when(head.isNotNull() & (F.col("local_sha") == F.col("remote_sha")), "error").when(head.isNotNull(), "park").when(local_only, "keep_local").when(paths.is_git_ref_class(rel), "veto").otherwise("keep_local")
    rows = group.withColumn("repo", paths.repo_root(rel)).withColumn("head_ref", head).withColumn("plan", said)
    vetoed = rows.groupBy("repo").agg(F.bool_or(F.col("plan").isin("veto", "error")).alias("vetoed"))
    park = F.when(F.col("plan") == "park", F.concat(F.lit("refs/parked/"), F.substr("head_ref", F.lit(len("refs/heads/") + 1)), F.lit("-"), F.substring("remote_sha", 1, 8)))
    return rows.join(vetoed, "repo").select("repo", "rel_path", "head_ref", park.alias("park_ref"), "local_sha", "remote_sha", F.when(F.col("vetoed") & ~F.col("plan").isin("veto", "error"), "blocked").otherwise(F.col("plan")).alias("plan"), clocks.merge(F.col("local_clock"), F.col("remote_clock")).alias("clock"))


def apply_changes(index: DataFrame, changes: DataFrame, path: str = "path") -> DataFrame:
    """Index rows (path, ..., seq) after changes of the same columns: the highest seq
    of a path wins; deletions are rows whose state is ``deleted`` (a rename is one of each)."""
    both = index.unionByName(changes)
    rest = [c for c in both.columns if c != path]
    return both.groupBy(path).agg(F.max_by(F.struct(*rest), "seq").alias("_r")).select(path, *[F.col(f"_r.{c}").alias(c) for c in rest])


def rename(index: DataFrame, moves: DataFrame, seq: Column, path: str = "path") -> DataFrame:
    """Changes that copy each source (from_path) to its target (to_path) and tombstone the source."""
    held = index.where("state <> 'deleted'").join(moves, F.col(path) == F.col("from_path"))
    made = held.select(*[F.col("to_path").alias(c) if c == path else seq.alias(c) if c == "seq" else F.col(c) for c in index.columns])
    gone = held.select(*[F.lit("deleted").alias(c) if c == "state" else seq.alias(c) if c == "seq" else F.col(c) for c in index.columns])
    return made.unionByName(gone)


def removable_directories(index: DataFrame, folders: DataFrame, path: str = "path") -> DataFrame:
    """Folders (path) without a live row below them."""
    live = index.where("state <> 'deleted'").select(path, F.lit(True).alias("live"))
    both = live.unionByName(folders.select(path, F.lit(False).alias("live"))).groupBy(path).agg(F.bool_or("live").alias("live"))
    used = tree.with_below(both, F.col("live"), path).where("has_below").select(path)
    return folders.join(used, path, "left_anti")


def read_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts (key, n, outcome): failures on transport, timeout or hash_mismatch before a success."""
    bad = F.col("outcome").isin("transport", "timeout", "hash_mismatch")
    per = attempts.groupBy("key").agg(F.count_if(bad).alias("failures"), F.min(F.when(F.col("outcome") == "ok", F.col("n"))).alias("succeeded_at"), F.max("n").alias("attempts"))
    return per.withColumn("ok", F.col("succeeded_at").isNotNull())
