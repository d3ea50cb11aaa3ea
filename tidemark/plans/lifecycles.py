"""Sweeps, eviction, trash, mutations, conflicts and metrics over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import clocks, ingress
from tidemark.operators import conflicts, lifecycle, metrics, reconcile, trees
from tidemark.plans.catalog import query
from tidemark.plans.core import SIDES, _plan_sql, plan
from tidemark.plans.fixtures import load

NOW, MAX_AGE = 400_000, 86_400
_TAG = f"CASE WHEN greatest({NOW} - last_synced, 0) <= {MAX_AGE} THEN 'young' WHEN exempt THEN 'exempt' WHEN NOT on_disk THEN 'missing' WHEN dirty THEN 'dirty' ELSE 'unsync' END"


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.tag_sweep(load(spark, d, "tracked").withColumn("path", F.col("rel_path")), NOW, MAX_AGE)


@query(f"SELECT count(*) AS scanned, count(*) FILTER (o = 'unsync') AS unsynced, count(*) FILTER (o = 'exempt') AS skipped_exempt, count(*) FILTER (o = 'dirty') AS skipped_dirty, count(*) FILTER (o = 'missing') AS skipped_missing, coalesce(sum(size) FILTER (o = 'unsync'), 0)::BIGINT AS bytes_reclaimed FROM (SELECT size, {_TAG} AS o FROM tracked)", "tracked")
def sweep_report(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.sweep_report(_tagged(spark, d))


@query(f"SELECT rel_path AS path, size FROM (SELECT *, {_TAG} AS o FROM tracked) WHERE o = 'unsync' ORDER BY last_synced, rel_path LIMIT 25", "tracked")
def bounded_sweep(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.bounded_sweep(_tagged(spark, d), 25).select("path", "size")


@query(f"SELECT rel_path AS path, size FROM (SELECT *, {_TAG} AS o FROM tracked) WHERE o = 'unsync'", "tracked")
def unbounded_sweep(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.bounded_sweep(_tagged(spark, d), 0).select("path", "size")


@query(f"SELECT rel_path AS path, size FROM (SELECT *, {_TAG.replace(str(MAX_AGE), str(MAX_AGE // 2))} AS o FROM tracked) WHERE o = 'unsync'", "tracked")
def pressure_sweep(spark: SparkSession, d: str) -> DataFrame:
    """A disk that is 95 percent full halves the age."""
    tagged = lifecycle.tag_sweep(load(spark, d, "tracked").withColumn("path", F.col("rel_path")), NOW, lifecycle.pressured_age(MAX_AGE, 95, 100, 0.9))
    return lifecycle.bounded_sweep(tagged, 0).select("path", "size")


_EVICT = "SELECT key, size FROM (SELECT hash AS key, size, sum(size) OVER ({0}) - coalesce(sum(size) OVER ({0} ORDER BY mtime, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain FROM {1}) WHERE remain > {2}"
_CACHE = "(SELECT hash, max(size) AS size, min(mtime) AS mtime, min(source) AS source FROM tree GROUP BY hash)"


def _cache(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "tree").groupBy(F.col("hash").alias("key")).agg(F.max("size").alias("size"), F.min("mtime").alias("mtime"), F.min("source").alias("source"))


@query(_EVICT.format("", _CACHE, 300000), "tree")
def lru_eviction(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.evict(_cache(spark, d), 300_000).select("key", "size")


@query(_EVICT.format("PARTITION BY source", _CACHE, 20000), "tree")
def lru_eviction_by_source(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.evict(_cache(spark, d), 20_000, group="source").select("key", "size")


@query("SELECT path, trash_key, trashed_at FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY trashed_at DESC NULLS LAST, trash_key DESC) AS n FROM trash) WHERE n = 1", "trash")
def trash_latest(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.latest(load(spark, d, "trash"), "path", F.col("trashed_at").desc_nulls_last(), F.col("trash_key").desc()).select("path", "trash_key", "trashed_at")


@query("SELECT path, trash_key, trashed_at FROM trash ORDER BY trashed_at DESC, trash_key DESC", "trash")
def trash_newest_first(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.trash_listing(load(spark, d, "trash")).select("path", "trash_key", "trashed_at")


@query("SELECT trash_key, CASE WHEN trashed_at IS NULL THEN 'retained' WHEN 5000000 - trashed_at > 2592000 THEN 'purge' ELSE 'keep' END AS outcome FROM trash", "trash")
def trash_purge(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.trash_purge(load(spark, d, "trash"), 5_000_000, 30 * 86_400).select("trash_key", "outcome")


@query("SELECT t.path, t.trash_key, CASE WHEN i.path IS NULL OR i.state = 'deleted' THEN 'restore' WHEN i.hash = t.hash THEN 'identical' ELSE 'destination_conflict' END AS outcome FROM trash t LEFT JOIN (SELECT DISTINCT path, CASE WHEN o_custkey % 4 = 1 THEN 'deleted' ELSE 'committed' END AS state, 'h1' AS hash FROM trash WHERE o_custkey % 3 <> 0) i ON i.path = t.path", "trash")
def trash_restore(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "trash")
    index = t.where("o_custkey % 3 <> 0").select("path", F.when(F.col("o_custkey") % 4 == 1, "deleted").otherwise("committed").alias("state"), F.lit("h1").alias("hash")).distinct()
    return lifecycle.trash_restore(t, index)


@query("WITH wanted AS (SELECT DISTINCT path FROM trash UNION SELECT 'absent'), per AS (SELECT path, count(*) AS n, min(trash_key) AS one FROM trash GROUP BY path) SELECT w.path, CASE WHEN n = 1 THEN one END AS trash_key, CASE WHEN n = 1 THEN 'ok' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS outcome FROM wanted w LEFT JOIN per ON per.path = w.path", "trash")
def trash_select(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "trash")
    return lifecycle.trash_select(t, t.select("path").distinct().unionByName(spark.range(1).select(F.lit("absent").alias("path"))))


_UNSYNC = "CASE WHEN doc_id % 13 = 0 THEN 'skip' WHEN dirty THEN 'dirty' WHEN on_disk AND doc_id % 11 = 0 THEN 'skip' WHEN NOT on_disk AND doc_id % 4 = 0 THEN 'already stubbed' WHEN NOT on_disk THEN 'hydrated file missing' ELSE 'unsync' END"


def _targets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    t = load(spark, d, "tracked").select(F.col("rel_path").alias("path"), F.when(k % 13 == 0, "directory").when(k % 11 == 0, "socket").otherwise("file").alias("kind"), "dirty", "on_disk", (k % 4 == 0).alias("stub"))
    return lifecycle.unsync_plan(t)


@query(f"SELECT rel_path AS path, {_UNSYNC} AS outcome FROM tracked", "tracked")
def unsync_plan(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d).select("path", "outcome")


@query(f"WITH rows_of AS (SELECT rel_path AS path, {_UNSYNC} AS outcome FROM tracked WHERE rel_path LIKE 'src1/%') SELECT path, CASE WHEN (SELECT bool_or(outcome = 'dirty') FROM rows_of) THEN 'aborted' ELSE outcome END AS outcome FROM rows_of", "tracked")
def directory_unsync(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.directory_unsync(_targets(spark, d), "src1").select("path", "outcome")


@query("SELECT path, remote_path FROM tracked WHERE conflict IS NULL AND (remote_path NOT LIKE 'store/%' OR ((path LIKE '/tmp/%' OR path LIKE '/private/tmp/%') AND NOT on_disk))", "tracked")
def stale_purge(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.stale(load(spark, d, "tracked"), "store//").select("path", "remote_path")


@query("SELECT w.rel_path AS path, coalesce(c.size, 0) AS bytes_freed, c.size IS NOT NULL AS was_cached FROM tracked w LEFT JOIN (SELECT rel_path, size FROM tree WHERE doc_id % 4 = 1) c ON c.rel_path = w.rel_path", "tracked tree")
def dehydrate(spark: SparkSession, d: str) -> DataFrame:
    cache = load(spark, d, "tree").where("doc_id % 4 = 1").select(F.col("rel_path").alias("key"), "size")
    return lifecycle.dehydrate(cache, load(spark, d, "tracked").select(F.col("rel_path").alias("path"), F.col("rel_path").alias("key")))


@query("SELECT count(*) FILTER (o = 'rotated') AS rotated, count(*) FILTER (o = 'already_rotated') AS already_rotated, count(*) FILTER (o = 'skipped_keyless') AS skipped_keyless, count(*) FILTER (o = 'skipped_per_device') AS skipped_per_device, count(*) FILTER (o = 'error') AS error, max(rel_path) AS last_path, CASE WHEN count(*) FILTER (o = 'error') > 0 THEN 'incomplete' ELSE 'ready_to_swap' END AS status FROM (SELECT rel_path, CASE WHEN doc_id % 7 = 0 THEN 'skipped_per_device' WHEN doc_id % 5 = 0 THEN 'skipped_keyless' WHEN doc_id % 3 = 0 THEN 'already_rotated' WHEN doc_id % 11 = 1 THEN 'error' ELSE 'rotated' END AS o FROM tree WHERE rel_path > 'src1')", "tree")
def rotation_report(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    rows = load(spark, d, "tree").select(F.col("rel_path").alias("path"), F.when(k % 5 == 0, None).when(k % 3 == 0, "new").when(k % 11 == 1, "other").otherwise("old").alias("key_id"), (k % 7 == 0).alias("per_device"))
    return lifecycle.rotation_report(lifecycle.rotation_scan(rows, "old", "new", after="src1"))


@query("SELECT name, sequence FROM devices WHERE (sequence % 9 = 4 OR sequence * 100 >= 500) AND NOT revoked AND sequence % 7 < 4", "devices")
def session_access(spark: SparkSession, d: str) -> DataFrame:
    """Some sessions never expire, one does at this very second; lists that allow, and unsafe or other prefixes that do not."""
    s = F.col("sequence")
    lists = [[], ["store/a"], ["/store/a/x/"], ["//", "store"], ["store/ab"], ["store//a", "store/./a", "store/../store/a"], ["store\\a", "store/a\t", ""]]
    prefixes = F.element_at(F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in lists)), (s % 7 + 1).cast("int"))
    sessions = load(spark, d, "devices").withColumn("expires_at", F.when(s % 9 != 4, s * 100)).withColumn("prefixes", prefixes)
    return lifecycle.live_sessions(sessions, 500, "/store/a/x").select("name", "sequence")


@query("""WITH g AS (SELECT doc_id, concat('r', (doc_id % 5)::VARCHAR) AS repo, CASE doc_id % 4 WHEN 0 THEN concat('.git/refs/heads/b', doc_id::VARCHAR) WHEN 1 THEN '.git/index' WHEN 2 THEN concat('.git/logs/', doc_id::VARCHAR) ELSE CASE WHEN doc_id % 5 = 3 THEN '.git/packed-refs' ELSE concat('.git/refs/heads/c', doc_id::VARCHAR) END END AS tail, hash FROM tree),
p AS (SELECT *, CASE WHEN tail LIKE '.git/refs/heads/%' THEN 'park' WHEN tail LIKE '%packed-refs' THEN 'veto' ELSE 'keep_local' END AS plan0 FROM g), v AS (SELECT repo, bool_or(plan0 = 'veto') AS veto FROM p GROUP BY repo)
SELECT doc_id, p.repo, CASE WHEN veto AND plan0 <> 'veto' THEN 'blocked' ELSE plan0 END AS plan, CASE WHEN plan0 = 'park' THEN concat('refs/parked/', substring(tail, 17), '-', substr(hash, 1, 8)) END AS park_ref, 'a:3,b:2' AS clock FROM p JOIN v ON v.repo = p.repo""", "tree")
def keep_both_plan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    n = k.cast("string")
    tail = F.when(k % 4 == 0, F.concat(F.lit(".git/refs/heads/b"), n)).when(k % 4 == 1, ".git/index").when(k % 4 == 2, F.concat(F.lit(".git/logs/"), n)).when(k % 5 == 3, ".git/packed-refs").otherwise(F.concat(F.lit(".git/refs/heads/c"), n))
    clock = lambda a, b: F.create_map(F.lit("a"), F.lit(a), F.lit("b"), F.lit(b)).cast("map<string,bigint>")
    rows = load(spark, d, "tree").select("doc_id", F.concat(F.lit("r"), (k % 5).cast("string"), F.lit("/"), tail).alias("rel_path"), F.lit("0").alias("local_sha"), F.col("hash").alias("remote_sha"), clock(3, 1).alias("local_clock"), clock(2, 2).alias("remote_clock"))
    named = rows.withColumn("remote_sha", F.concat("remote_sha", F.lit("|"), "doc_id"))
    found = lifecycle.keep_both(named)
    return found.select(F.substring_index("remote_sha", "|", -1).cast("long").alias("doc_id"), "repo", "plan", "park_ref", clocks.text(F.col("clock")).alias("clock"))


@query("""SELECT path, arg_max(hash, seq) AS hash, arg_max(state, seq) AS state, max(seq) AS seq FROM (SELECT rel_path AS path, hash, state, doc_id AS seq FROM remote_side UNION ALL SELECT rel_path, hash, CASE WHEN doc_id % 4 = 0 THEN 'deleted' ELSE 'committed' END, doc_id + CASE WHEN doc_id % 2 = 0 THEN 1000000 ELSE -1000000 END FROM local_side) GROUP BY path""", "remote_side local_side")
def applied_changes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    index = load(spark, d, "remote_side").select(F.col("rel_path").alias("path"), "hash", "state", k.alias("seq"))
    changes = load(spark, d, "local_side").select(F.col("rel_path").alias("path"), "hash", F.when(k % 4 == 0, "deleted").otherwise("committed").alias("state"), (k + F.when(k % 2 == 0, 1_000_000).otherwise(-1_000_000)).alias("seq"))
    return lifecycle.apply_changes(index, changes)


@query("""SELECT concat('moved/', rel_path) AS path, hash, state, 9 AS seq FROM remote_side WHERE doc_id % 6 = 1 AND state <> 'deleted' UNION ALL SELECT rel_path, hash, 'deleted', 9 FROM remote_side WHERE doc_id % 6 = 1 AND state <> 'deleted'""", "remote_side")
def renamed_paths(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "remote_side")
    moves = r.where("doc_id % 6 = 1").select(F.col("rel_path").alias("from_path"), F.concat(F.lit("moved/"), "rel_path").alias("to_path"))
    return lifecycle.rename(r.select(F.col("rel_path").alias("path"), "hash", "state", F.lit(1).alias("seq")), moves, F.lit(9))


@query("WITH live AS (SELECT source, lang FROM tree WHERE doc_id % 5 = 0), f AS (SELECT DISTINCT concat(source, '/', lang) AS path FROM tree) SELECT path FROM f WHERE path NOT IN (SELECT concat(source, '/', lang) FROM live)", "tree")
def removable_directories(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "tree")
    index = t.select(F.col("rel_path").alias("path"), F.when(F.col("doc_id") % 5 == 0, "committed").otherwise("deleted").alias("state"))
    return lifecycle.removable_directories(index, t.select(F.concat_ws("/", "source", "lang").alias("path")).distinct())


@query("""SELECT concat('u', user_id::VARCHAR) AS key, count(*) FILTER (event_type <> 'view' AND event_type <> 'click') AS failures, min(CASE WHEN event_type IN ('view', 'click') THEN event_id END) AS succeeded_at, max(event_id) AS attempts, count(*) FILTER (event_type IN ('view', 'click')) > 0 AS ok FROM events GROUP BY user_id""")
def read_attempts(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "log_events")
    outcome = F.when(F.col("event_type").isin("view", "click"), "ok").when(F.col("event_type") == "error", "transport").when(F.col("event_type") == "signup", "timeout").otherwise("hash_mismatch")
    return lifecycle.read_attempts(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("n"), outcome.alias("outcome")))


_CYCLES = "cycles AS (SELECT rel_path, c AS cycle, doc_id * 10 + c AS detected_at FROM tracked, unnest([1, 2, 3]) AS u(c) WHERE conflict IS NOT NULL AND doc_id % (c + 1) = 1)"


def _cycles(spark: SparkSession, d: str) -> DataFrame:
    rows = lifecycle.conflicts(load(spark, d, "tracked")).select("rel_path", "doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("cycle"))
    return rows.where("doc_id % (cycle + 1) = 1").select("rel_path", "cycle", (F.col("doc_id") * 10 + F.col("cycle")).alias("detected_at"))


@query(f"WITH {_CYCLES} SELECT rel_path, arg_min(detected_at, cycle) AS detected_at, count(*) AS times_recorded, max(cycle) AS last_cycle FROM cycles GROUP BY rel_path", "tracked")
def conflict_ledger(spark: SparkSession, d: str) -> DataFrame:
    return conflicts.ledger(_cycles(spark, d))


@query(f"WITH {_CYCLES}, held AS (SELECT rel_path, arg_min(detected_at, cycle) AS d0, count(*) AS n FROM cycles WHERE cycle < 3 GROUP BY rel_path), found AS (SELECT rel_path, detected_at AS d1 FROM cycles WHERE cycle = 3) SELECT coalesce(h.rel_path, f.rel_path) AS rel_path, coalesce(d0, d1) AS detected_at, coalesce(n, 0) + CASE WHEN d1 IS NULL THEN 0 ELSE 1 END AS times_recorded, 'conflict' AS status FROM held h FULL OUTER JOIN found f ON h.rel_path = f.rel_path", "tracked")
def conflict_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = _cycles(spark, d)
    return conflicts.upsert(conflicts.ledger(c.where("cycle < 3")), c.where("cycle = 3"))


_GIT = "items AS (SELECT path AS rel_path, CASE WHEN path LIKE '%/.git/%' THEN regexp_extract(path, '^(.*?)/\\.git/', 1) END AS repo_root, path LIKE '%/.git/refs/heads/%' AS head, concat('c', doc_id::VARCHAR) AS cache_key FROM inventory)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "inventory").select(F.col("path").alias("rel_path"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("cache_key"))


@query(f"WITH {_GIT} SELECT repo_root, count(*) AS n, count(*) FILTER (head) AS heads, min(rel_path) AS first_path, max(rel_path) AS last_path FROM items GROUP BY repo_root", "inventory")
def conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    return conflicts.group_counts(_items(spark, d))


@query(f"WITH {_GIT} SELECT DISTINCT repo_root, rel_path FROM items", "inventory")
def conflict_group_paths(spark: SparkSession, d: str) -> DataFrame:
    return conflicts.groups(_items(spark, d))


@query(f"WITH {_GIT} SELECT rel_path, cache_key FROM items ORDER BY rel_path, cache_key", "inventory")
def conflict_listing(spark: SparkSession, d: str) -> DataFrame:
    return conflicts.listing(_items(spark, d))


_CONFLICT = "CASE WHEN doc_id % 20 = 9 THEN NULL WHEN doc_id % 15 = 1 THEN 'left over' ELSE conflict END"


@query(f"SELECT count(*) AS total, count(*) FILTER (status = 'not_synced') AS not_synced, count(*) FILTER (status = 'synced') AS synced, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'locked') AS locked, count(*) FILTER (status = 'conflict') AS conflict, count(*) FILTER ((status = 'conflict') <> ({_CONFLICT} IS NOT NULL)) AS inconsistent FROM tracked", "tracked")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return conflicts.status_counts(load(spark, d, "tracked").withColumn("conflict", F.expr(_CONFLICT)))


@query(f"SELECT count(*) AS entries, count(conflict) AS conflicts, count(*) FILTER ({NOW} - last_synced > {MAX_AGE} AND NOT exempt) AS unsync_eligible FROM tracked", "tracked")
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return conflicts.diagnostics(load(spark, d, "tracked"), NOW, MAX_AGE)


_FF = "heads AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('r', (doc_id % 7)::VARCHAR, '/.git/refs/heads/b', doc_id::VARCHAR) WHEN 1 THEN concat('r', (doc_id % 7)::VARCHAR, '/.git/objects/', doc_id::VARCHAR) ELSE CASE WHEN doc_id % 7 = 2 THEN 'r2/.git/packed-refs' ELSE concat('f', doc_id::VARCHAR) END END AS rel_path, CASE WHEN doc_id % 7 IN (0, 2) THEN 'local_ahead' WHEN doc_id % 7 = 1 THEN 'remote_ahead' WHEN doc_id % 2 = 0 THEN 'local_ahead' ELSE 'remote_ahead' END AS direction FROM tree)"


@query(f"""WITH {_FF}, c AS (SELECT *, CASE WHEN rel_path LIKE '%/.git/%' THEN split_part(rel_path, '/', 1) END AS repo, rel_path LIKE '%/refs/heads/%' AS head, rel_path LIKE '%packed-refs' AS veto FROM heads),
dec AS (SELECT repo, CASE WHEN min(direction) FILTER (head) = 'local_ahead' THEN 'push' ELSE 'pull' END AS decision FROM c WHERE repo IS NOT NULL GROUP BY repo HAVING NOT bool_or(veto) AND count(*) FILTER (head) > 0 AND min(direction) FILTER (head) = max(direction) FILTER (head))
SELECT rel_path, coalesce(decision, 'conflict') AS action, CASE WHEN decision IS NULL THEN 'conflict' ELSE 'git_fast_forward' END AS reason FROM c LEFT JOIN dec ON dec.repo = c.repo""", "tree")
def ff_reclassify(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    repo = F.concat(F.lit("r"), (k % 7).cast("string"))
    rel = F.when(k % 3 == 0, F.concat(repo, F.lit("/.git/refs/heads/b"), k.cast("string"))).when(k % 3 == 1, F.concat(repo, F.lit("/.git/objects/"), k.cast("string"))).when(k % 7 == 2, "r2/.git/packed-refs").otherwise(F.concat(F.lit("f"), k.cast("string")))
    direction = F.when((k % 7).isin(0, 2), "local_ahead").when(k % 7 == 1, "remote_ahead").when(k % 2 == 0, "local_ahead").otherwise("remote_ahead")
    rows = load(spark, d, "tree").select(rel.alias("rel_path"), F.lit("conflict").alias("action"), F.lit("conflict").alias("reason"), direction.alias("direction"))
    heads = rows.where(F.contains("rel_path", F.lit("/refs/heads/"))).select("rel_path", "direction")
    return reconcile.reclassify_fast_forwards(rows.drop("direction"), heads)


@query("""WITH pairs AS (SELECT DISTINCT o_orderkey AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 4 WHEN o_orderkey % 3 = 1 THEN o_orderkey * 2 ELSE o_orderkey + 1 END AS b FROM orders),
tips AS (SELECT a AS tip FROM pairs UNION SELECT b FROM pairs), line AS (SELECT tip, k, tip >> k AS above, tip >> (k - 1) AS below FROM tips, unnest(range(1, 48)) AS u(k) WHERE tip >> (k - 1) > 1),
known AS (SELECT l.*, bool_and(o.o_orderkey IS NOT NULL) OVER (PARTITION BY tip ORDER BY k) AS unbroken FROM line l LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders) o ON o.o_orderkey = l.below)
SELECT concat('n', a::VARCHAR) AS local, concat('n', b::VARCHAR) AS remote, CASE WHEN x.tip IS NOT NULL THEN 'local_ahead' WHEN y.tip IS NOT NULL THEN 'remote_ahead' ELSE 'neither' END AS direction
FROM pairs LEFT JOIN known x ON x.tip = a AND x.above = b AND x.unbroken LEFT JOIN known y ON y.tip = b AND y.above = a AND y.unbroken""")
def commit_ancestry(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a commit whose parent is its half, against another; the SQL takes halves by shifting."""
    from tidemark.sources.tables import read_table

    k = F.col("o_orderkey")
    other = F.when(k % 3 == 0, F.floor(k / 4)).when(k % 3 == 1, k * 2).otherwise(k + 1)
    name = lambda x: F.concat(F.lit("n"), x.cast("long").cast("string"))
    return trees.ancestry(load(spark, d, "commits"), read_table(spark, d, "orders").select(name(k).alias("local"), name(other).alias("remote")))


_STRATEGY = "CASE event_id % 5 WHEN 0 THEN 'keep_local' WHEN 1 THEN 'keep_remote' WHEN 2 THEN 'keep_both' WHEN 3 THEN 'defer' ELSE 'merge' END"


@query(f"""SELECT event_id, CASE WHEN s = 'merge' THEN false WHEN s = 'defer' THEN true WHEN s <> 'keep_both' OR event_id % 2 = 0 THEN false ELSE event_id % 3 <> 0 AND event_id % 7 <> 0 END AS accepted,
 CASE WHEN s = 'merge' THEN 'unknown strategy' WHEN s = 'defer' THEN 'no change' WHEN s <> 'keep_both' OR event_id % 2 = 0 THEN 'refused per file' WHEN event_id % 3 = 0 OR event_id % 7 = 0 THEN 'needs pull and push' ELSE 'park remote heads' END AS reason FROM (SELECT event_id, {_STRATEGY} AS s FROM events)""")
def resolution_plan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    found = conflicts.resolution(F.expr(_STRATEGY), k % 2 == 1, k % 3 != 0, k % 7 != 0)
    return load(spark, d, "log_events").select("event_id", found.alias("x")).select("event_id", "x.*")


_LE = "[" + ", ".join(f"'{b}'" for b in [*metrics.BUCKETS, "+Inf"]) + "]"


@query(f"SELECT l_returnflag AS label, le, count(*) FILTER (le = '+Inf' OR s <= try_cast(le AS DOUBLE)) AS n FROM (SELECT l_returnflag, (l_partkey % 977) / 8.0 AS s FROM lineitem), unnest({_LE}) AS u(le) GROUP BY l_returnflag, le")
def task_histogram(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.sources.tables import read_table

    tasks = read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), (F.col("l_partkey") % 977 / 8.0).alias("seconds"))
    return metrics.histogram(tasks, "label", "seconds")



@query(f"""SELECT count(*) AS rows, count(*) FILTER (flag = 'true') AS flag_true, count(*) FILTER (flag = 'false') AS flag_false, count(*) FILTER (flag IS NULL) AS flag_absent, sum(chunks)::BIGINT AS chunks, sum(bytes)::BIGINT AS bytes, sum(greatest(bytes - uploaded_bytes, 0))::BIGINT AS bytes_not_uploaded, array_to_string(list_sort(list(DISTINCT concurrency)), ',') AS concurrency,
 count(*) FILTER (l_partkey % 5 = 0) AS pack_rows, coalesce(sum(chunks) FILTER (l_partkey % 5 = 0), 0)::BIGINT AS pack_chunks, coalesce(sum(bytes) FILTER (l_partkey % 5 = 0), 0)::BIGINT AS pack_bytes, count(*) FILTER (l_partkey % 5 = 1) AS pack_index_rows, coalesce(sum(chunks) FILTER (l_partkey % 5 = 1), 0)::BIGINT AS pack_index_chunks, coalesce(sum(bytes) FILTER (l_partkey % 5 = 1), 0)::BIGINT AS pack_index_bytes, min(ts) AS first_ts, max(ts) AS last_ts, min(seq) AS first_seq, max(seq) AS last_seq FROM push_log""", "push_log")
def push_summary(spark: SparkSession, d: str) -> DataFrame:
    """Without the argmax paths: the table's sequence repeats, see push_argmax."""
    return metrics.push_summary(load(spark, d, "push_log").withColumn("path", F.col("file"))).drop("most_chunks", "most_bytes", "slowest")


@query("WITH u AS (SELECT l_partkey, max(bytes) AS bytes, max(chunks) AS chunks, max(elapsed_ms) AS elapsed_ms FROM push_log GROUP BY l_partkey) SELECT (SELECT concat('p', l_partkey::VARCHAR) FROM u ORDER BY chunks DESC, l_partkey LIMIT 1) AS most_chunks, (SELECT concat('p', l_partkey::VARCHAR) FROM u ORDER BY bytes DESC, l_partkey LIMIT 1) AS most_bytes, (SELECT concat('p', l_partkey::VARCHAR) FROM u ORDER BY elapsed_ms DESC, l_partkey LIMIT 1) AS slowest", "push_log")
def push_argmax(spark: SparkSession, d: str) -> DataFrame:
    """T11 with a unique sequence (the part), so that the first seen is defined."""
    per = load(spark, d, "push_log").groupBy("path", F.col("l_partkey").alias("seq")).agg(*[F.max(c).alias(c) for c in ("chunks", "bytes", "elapsed_ms", "uploaded_bytes")]).withColumn("flag", F.lit(None).cast("string")).withColumn("ts", F.col("seq")).withColumn("concurrency", F.lit(1))
    return metrics.push_summary(per).select("most_chunks", "most_bytes", "slowest")


@query("SELECT count(*) FILTER (uploaded_bytes > 0) AS uploaded, count(*) FILTER (uploaded_bytes = 0) AS skipped, sum(chunks) FILTER (uploaded_bytes > 0)::BIGINT AS chunks, sum(bytes) FILTER (uploaded_bytes > 0)::BIGINT AS bytes, sum(uploaded_bytes)::BIGINT AS uploaded_bytes FROM push_log", "push_log")
def push_totals(spark: SparkSession, d: str) -> DataFrame:
    return metrics.push_totals(load(spark, d, "push_log"))


@query("SELECT seq, file AS path, bytes, flag FROM push_log", "push_log")
def push_lines(spark: SparkSession, d: str) -> DataFrame:
    """Log lines read back into their fields."""
    line = F.concat(F.lit("2026-01-01T00:00:00Z seq="), F.col("seq").cast("string"), F.lit(" path="), F.col("file"), F.lit(" bytes="), F.col("bytes").cast("string"), F.coalesce(F.concat(F.lit(" flag="), "flag"), F.lit("")))
    fields = load(spark, d, "push_log").select(metrics.parse_push_line(line).alias("f"))
    get = lambda k: F.try_element_at("f", F.lit(k))
    return fields.select(get("seq").cast("long").alias("seq"), get("path").alias("path"), get("bytes").cast("long").alias("bytes"), get("flag").alias("flag"))


@query("SELECT metric, value, CASE metric WHEN 'orders' THEN 1000 WHEN 'customers' THEN 0 WHEN 'parts' THEN 5 ELSE 0 END AS budget, CASE metric WHEN 'orders' THEN CASE WHEN value <= 1000 THEN 'ok' ELSE 'over' END WHEN 'parts' THEN 'over' ELSE 'observe' END AS verdict FROM (SELECT 'orders' AS metric, count(*) AS value FROM orders UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'parts', count(*) FROM part)")
def slo_eval(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.sources.tables import read_table

    count = lambda t, m: read_table(spark, d, t).agg(F.count("*").alias("value")).select(F.lit(m).alias("metric"), "value")
    observed = count("orders", "orders").unionByName(count("customer", "customers")).unionByName(count("part", "parts"))
    return metrics.slo(observed, spark.createDataFrame([("orders", 1000), ("customers", 0), ("parts", 5)], "metric string, budget int"))


@query("SELECT CASE WHEN g = 0 THEN decision END AS decision, CASE WHEN g = 1 THEN reason END AS reason, count(*) AS n FROM (SELECT CASE WHEN path LIKE '%/target/%' OR path LIKE '%/.ssh/%' OR path LIKE '%/node_modules/%' OR path LIKE '%/worktrees/%' THEN 'deny' ELSE 'other' END AS decision, CASE WHEN path LIKE '%/.git/%' THEN 'git' ELSE 'plain' END AS reason FROM inventory), unnest([0, 1]) AS u(g) GROUP BY 1, 2", "inventory")
def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    deny = p.rlike("/(target|[.]ssh|node_modules|worktrees)/")
    return metrics.decision_counts(load(spark, d, "inventory").select(F.when(deny, "deny").otherwise("other").alias("decision"), F.when(F.contains(p, F.lit("/.git/")), "git").otherwise("plain").alias("reason")))


@query(f"SELECT sum(size)::BIGINT AS total_bytes, count(*) AS entry_count, count(DISTINCT substr(hash, 1, 2)) AS shard_count FROM {_CACHE}", "tree")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cache_stats(_cache(spark, d))


@query("SELECT count(*) AS active, count(*) FILTER (capable) AS capable, coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (NOT capable)), ','), '') AS incapable FROM devices WHERE NOT revoked", "devices")
def roll_call(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roll_call(load(spark, d, "devices"))


@query("SELECT count(*) FILTER (action = 'push' AND outcome = 'ok') AS pushed, count(*) FILTER (action = 'pull' AND outcome = 'ok') AS pulled, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'error') AS errors, coalesce(sum(bytes) FILTER (outcome = 'ok'), 0)::BIGINT AS bytes FROM (SELECT action, length(rel_path)::BIGINT AS bytes, CASE length(rel_path) % 7 WHEN 0 THEN 'skipped' WHEN 1 THEN 'error' ELSE 'ok' END AS outcome FROM p)".join([_plan_sql(False, False) + " ", ""]), SIDES)
def execution_result(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("rel_path")
    rows = plan(spark, d).select("action", n.cast("long").alias("bytes"), F.when(n % 7 == 0, "skipped").when(n % 7 == 1, "error").otherwise("ok").alias("outcome"))
    return metrics.execution_result(rows)


@query("SELECT count(*) FILTER (NOT is_symlink) AS files, 0::BIGINT AS directories, count(*) FILTER (is_symlink) AS symlinks, count(*) FILTER (doc_id % 41 = 0) AS faults, sum(size) FILTER (NOT is_symlink)::BIGINT AS bytes FROM inventory", "inventory")
def inventory_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "inventory").select(F.when(F.col("is_symlink"), "symlink").otherwise("file").alias("kind"), "size", F.when(F.col("doc_id") % 41 == 0, "unreadable").alias("fault"))
    return metrics.inventory_counts(rows)


@query("SELECT concat('p', l_partkey::VARCHAR) AS path, l_quantity::BIGINT % 5 AS priority, l_orderkey AS created_at FROM lineitem ORDER BY priority DESC, created_at, path")
def queue_order(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "push_log").select("path", (F.col("chunks") % 5).alias("priority"), F.col("l_orderkey").alias("created_at"))
    return metrics.queue_order(rows)


@query("SELECT device_id, seq FROM (SELECT device_id, seq, row_number() OVER (PARTITION BY device_id ORDER BY seq DESC) AS n FROM log_events) WHERE n <= 5", "log_events")
def last_samples(spark: SparkSession, d: str) -> DataFrame:
    return metrics.last_samples(load(spark, d, "log_events").select("device_id", "seq"), "device_id", 5)


@query("WITH s AS (SELECT device_id AS device, seq, event_type <> 'error' AND event_type <> 'view' AS ok FROM log_events), l AS (SELECT device, max(seq) FILTER (ok) AS last_ok FROM s GROUP BY device) SELECT s.device, count(*) FILTER (NOT ok AND seq > coalesce(last_ok, -1)) AS failures, count(*) FILTER (NOT ok AND seq > coalesce(last_ok, -1)) >= 5 AS locked FROM s JOIN l ON l.device = s.device GROUP BY s.device", "log_events")
def device_failures(spark: SparkSession, d: str) -> DataFrame:
    return metrics.lockouts(load(spark, d, "log_events").select(F.col("device_id").alias("device"), "seq", (~F.col("event_type").isin("error", "view")).alias("ok")))


@query("SELECT path, sum(bytes)::BIGINT AS units, sum(elapsed_ms)::BIGINT AS ms, CASE WHEN sum(elapsed_ms) > 0 THEN round(sum(bytes) / (sum(elapsed_ms) / 1000.0), 6) ELSE 0.0 END AS rate FROM push_log GROUP BY path", "push_log")
def push_rates(spark: SparkSession, d: str) -> DataFrame:
    per = load(spark, d, "push_log").groupBy("path").agg(F.sum("bytes").alias("units"), F.sum("elapsed_ms").alias("ms"))
    return per.withColumn("rate", F.round(metrics.rate(F.col("units"), F.col("ms") / 1000.0), 6))
