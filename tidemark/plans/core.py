"""Reconciliation, clocks and content-addressed storage over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import clocks, paths
from tidemark.operators import cas, reconcile
from tidemark.plans.catalog import query
from tidemark.plans.fixtures import load

DEVICE = "a"
#: Both-present outcome with the inferred tick, as SQL over aliases l, r and t.
_SAME = """CASE WHEN l.hash = r.hash THEN 'up_to_date'
    WHEN ca2 >= r.ca AND l.cb >= r.cb AND (ca2 > r.ca OR l.cb > r.cb) THEN 'local_newer'
    WHEN ca2 <= r.ca AND l.cb <= r.cb AND (ca2 < r.ca OR l.cb < r.cb) THEN 'remote_newer' ELSE 'conflict' END"""


def _plan_sql(delete_local: bool, delete_remote: bool, sides: str = "local_side remote_side tracked") -> str:
    own, other, held = sides.split()
    return f"""WITH keys AS (SELECT rel_path FROM {own} UNION SELECT rel_path FROM {other} UNION SELECT rel_path FROM {held}),
j AS (SELECT k.rel_path, l.rel_path IS NOT NULL AS here, r.rel_path IS NOT NULL AND r.state <> 'deleted' AS there, coalesce(r.state = 'deleted', false) AS tomb, t.rel_path IS NOT NULL AS known,
  l.hash AS lh, r.hash AS rh, t.hash AS th, l.ca, l.cb, r.ca AS rca, r.cb AS rcb,
  l.ca + CASE WHEN t.hash IS NOT NULL AND t.hash <> l.hash AND l.ca <= r.ca AND l.cb <= r.cb AND (l.ca < r.ca OR l.cb < r.cb) THEN 1 ELSE 0 END AS ca2
  FROM keys k LEFT JOIN {own} l USING (rel_path) LEFT JOIN {other} r ON r.rel_path = k.rel_path LEFT JOIN {held} t ON t.rel_path = k.rel_path),
v AS (SELECT rel_path, CASE
  WHEN here AND there THEN CASE WHEN lh = rh THEN 'up_to_date'
    WHEN ca2 >= rca AND cb >= rcb AND (ca2 > rca OR cb > rcb) THEN 'local_newer'
    WHEN ca2 <= rca AND cb <= rcb AND (ca2 < rca OR cb < rcb) THEN 'remote_newer' ELSE 'conflict' END
  WHEN here AND NOT known THEN 'new_local'
  WHEN there AND known THEN {"'orphan_remote'" if delete_remote else "'up_to_date'"}
  WHEN there THEN 'new_remote'
  WHEN here AND lh <> th AND (rel_path LIKE '%/.git/%') THEN 'local_newer'
  WHEN here AND tomb THEN {"'deleted_remotely'" if delete_local else "'up_to_date'"}
  ELSE 'up_to_date' END AS reason FROM j),
p AS (SELECT rel_path, CASE reason WHEN 'local_newer' THEN 'push' WHEN 'new_local' THEN 'push' WHEN 'remote_newer' THEN 'pull' WHEN 'new_remote' THEN 'pull'
  WHEN 'conflict' THEN 'conflict' WHEN 'orphan_remote' THEN 'delete_remote' WHEN 'deleted_remotely' THEN 'delete_local' ELSE 'up_to_date' END AS action, reason FROM v)"""


SIDES = "local_side remote_side tracked"


def plan(spark: SparkSession, d: str, **flags) -> DataFrame:
    local = load(spark, d, "local_side").select("rel_path", "hash", "clock")
    remote = load(spark, d, "remote_side").select("rel_path", "hash", "clock", "state")
    return reconcile.plan(local, remote, load(spark, d, "tracked").select("rel_path", "hash"), DEVICE, **flags)


@query(_plan_sql(False, False) + " SELECT rel_path, action, reason FROM p", SIDES)
def reconcile_plan(spark: SparkSession, d: str) -> DataFrame:
    return plan(spark, d)


GIT_SIDES = "git_local git_remote git_tracked"


@query(_plan_sql(True, True, GIT_SIDES) + " SELECT rel_path, action, reason FROM p", GIT_SIDES)
def reconcile_git_refs(spark: SparkSession, d: str) -> DataFrame:
    """J02 with refs: one that changed here and is gone remotely is pushed, never deleted."""
    local, remote = load(spark, d, "git_local").select("rel_path", "hash", "clock"), load(spark, d, "git_remote").select("rel_path", "hash", "clock", "state")
    return reconcile.plan(local, remote, load(spark, d, "git_tracked").select("rel_path", "hash"), DEVICE, delete_local_orphans=True, delete_remote_orphans=True)


@query("""SELECT l.rel_path, CASE WHEN l.doc_id % 6 = 0 OR l.hash <> r.hash THEN 'differs' ELSE 'equal' END AS same, concat('logical-content-v1:', CASE WHEN l.doc_id % 6 = 0 THEN 'symlink' ELSE 'regular_file' END, ':', l.hash) AS identity,
 sha256(concat('manifest-object-v1', chr(0), l.rel_path)) AS manifest_id, sha256(concat('symlink-v1', chr(0), l.rel_path)) AS symlink_id, sha256(concat('namespace-reservation-v1', chr(0), lower(l.rel_path))) AS reservation_id FROM local_side l JOIN remote_side r ON r.rel_path = l.rel_path""", SIDES)
def content_identities(spark: SparkSession, d: str) -> DataFrame:
    """Identities with their kinds, and ids with their domains."""
    k = F.col("doc_id")
    here = load(spark, d, "local_side").select("doc_id", "rel_path", reconcile.identity(F.when(k % 6 == 0, "symlink").otherwise("regular_file"), F.col("hash")).alias("identity"))
    there = load(spark, d, "remote_side").select("rel_path", reconcile.identity(F.lit("regular_file"), F.col("hash")).alias("other"))
    path = F.col("rel_path")
    ids = [cas.content_id(path, "manifest-object-v1").alias("manifest_id"), cas.content_id(path, "symlink-v1").alias("symlink_id"), cas.content_id(paths.casefold(path), "namespace-reservation-v1").alias("reservation_id")]
    return here.join(there, "rel_path").select("rel_path", F.when(F.col("identity") == F.col("other"), "equal").otherwise("differs").alias("same"), "identity", *ids)


@query(_plan_sql(True, True) + " SELECT rel_path, action, reason FROM p", SIDES)
def reconcile_plan_deleting(spark: SparkSession, d: str) -> DataFrame:
    return plan(spark, d, delete_local_orphans=True, delete_remote_orphans=True)


@query(_plan_sql(False, False) + " SELECT action, count(*) AS n FROM p GROUP BY action", SIDES)
def reconcile_summary(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.summary(plan(spark, d))


@query(_plan_sql(True, True) + """ SELECT rel_path, action, CASE action WHEN 'conflict' THEN 0 WHEN 'pull' THEN 2 WHEN 'push' THEN 3 WHEN 'delete_local' THEN 4 WHEN 'delete_remote' THEN 5 ELSE 6 END AS rank
FROM p ORDER BY rank, rel_path""", SIDES)
def reconcile_ranked(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.ranked(plan(spark, d, delete_local_orphans=True, delete_remote_orphans=True)).select("rel_path", "action", "rank")


@query("""SELECT coalesce(l.rel_path, r.rel_path) AS path, CASE WHEN r.rel_path IS NULL THEN 'local_only' WHEN l.rel_path IS NULL THEN 'remote_only' WHEN l.hash = r.hash THEN 'unchanged' ELSE 'modified' END AS status
FROM local_side l FULL OUTER JOIN remote_side r ON l.rel_path = r.rel_path""", "local_side remote_side")
def diff_two_way(spark: SparkSession, d: str) -> DataFrame:
    side = lambda n: load(spark, d, n).select(F.col("rel_path").alias("path"), "hash")
    return reconcile.two_way_diff(side("local_side"), side("remote_side"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "remote_side").select("doc_id", F.col("clock").alias("r"), F.col("hash").alias("rh"))
    return load(spark, d, "local_side").select("doc_id", F.col("clock").alias("l"), F.col("hash").alias("lh"), "ca", "cb").join(r, "doc_id")


_ORDER = "CASE WHEN (l.ca > r.ca OR l.cb > r.cb) AND (l.ca < r.ca OR l.cb < r.cb) THEN 'concurrent' WHEN l.ca > r.ca OR l.cb > r.cb THEN 'greater' WHEN l.ca < r.ca OR l.cb < r.cb THEN 'less' ELSE 'equal' END"
_BOTH = "FROM local_side l JOIN remote_side r USING (doc_id)"


@query(f"SELECT doc_id, {_ORDER} AS \"order\", {_ORDER} = 'concurrent' AS concurrent {_BOTH}", "local_side remote_side")
def clock_compare(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("doc_id", clocks.compare(F.col("l"), F.col("r")).alias("order"), clocks.is_concurrent(F.col("l"), F.col("r")).alias("concurrent"))


@query(f"SELECT doc_id, concat('a:', greatest(l.ca, r.ca)::VARCHAR, ',b:', greatest(l.cb, r.cb)::VARCHAR) AS merged {_BOTH}", "local_side remote_side")
def clock_merge(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("doc_id", clocks.text(clocks.merge(F.col("l"), F.col("r"))).alias("merged"))


@query("SELECT doc_id, concat('a:', ca::VARCHAR, ',b:', cb::VARCHAR, ',c:1') AS ticked, ca AS at_a, 0::BIGINT AS at_z FROM local_side", "local_side")
def clock_tick(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("clock")
    return load(spark, d, "local_side").select("doc_id", clocks.text(clocks.tick(c, F.lit("c"))).alias("ticked"), clocks.get(c, F.lit("a")).alias("at_a"), clocks.get(c, F.lit("z")).alias("at_z"))


@query(f"SELECT doc_id, CASE WHEN l.hash = r.hash THEN 'up_to_date' ELSE CASE {_ORDER} WHEN 'greater' THEN 'local_newer' WHEN 'less' THEN 'remote_newer' ELSE 'conflict' END END AS outcome {_BOTH}", "local_side remote_side")
def sync_outcome(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("doc_id", clocks.outcome(F.col("l"), F.col("r"), F.col("lh"), F.col("rh")).alias("outcome"))


@query("""SELECT source, lang, max(1 + doc_id % 3) AS a, max(doc_id % 2) AS b, concat('a:', max(1 + doc_id % 3)::VARCHAR, ',b:', max(doc_id % 2)::VARCHAR) AS merged FROM documents GROUP BY source, lang""")
def clock_merge_rows(spark: SparkSession, d: str) -> DataFrame:
    """Pointwise maximum over rows, by device, then the map."""
    rows = load(spark, d, "tree").select("source", "lang", F.explode(F.create_map(F.lit("a"), 1 + F.col("doc_id") % 3, F.lit("b"), F.col("doc_id") % 2)).alias("device", "n"))
    per = rows.groupBy("source", "lang", "device").agg(F.max("n").alias("n"))
    merged = per.groupBy("source", "lang").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("device", "n")))).alias("c"))
    return merged.select("source", "lang", clocks.get(F.col("c"), F.lit("a")).alias("a"), clocks.get(F.col("c"), F.lit("b")).alias("b"), clocks.text(F.col("c")).alias("merged"))


@query("SELECT event_id, CASE WHEN concat('dev', (user_id % 8)::VARCHAR) <= concat('dev', (event_id % 8)::VARCHAR) THEN 'keep_local' ELSE 'keep_remote' END AS resolution FROM events")
def auto_resolve(spark: SparkSession, d: str) -> DataFrame:
    dev = lambda c: F.concat(F.lit("dev"), (F.col(c) % 8).cast("string"))
    return load(spark, d, "log_events").select("event_id", clocks.auto_resolution(dev("user_id"), dev("event_id")).alias("resolution"))


@query("""SELECT t.rel_path AS path, CASE WHEN s.rel_path IS NULL THEN 'new file' WHEN t.size <> s.size THEN 'size changed' WHEN t.mtime <> s.mtime AND l.hash <> s.hash THEN 'content changed' END AS reason
FROM tree t JOIN local_side l ON l.rel_path = t.rel_path LEFT JOIN tracked s ON s.rel_path = t.rel_path""", "tree local_side tracked")
def needs_sync(spark: SparkSession, d: str) -> DataFrame:
    hashes = load(spark, d, "local_side").select("rel_path", F.col("hash"))
    files = load(spark, d, "tree").drop("hash").join(hashes, "rel_path").select(F.col("rel_path").alias("path"), "size", "mtime", "hash")
    return reconcile.needs_sync(files, load(spark, d, "tracked").select(F.col("rel_path").alias("path"), "size", "mtime", "hash"))


CHUNKS = """chunks AS (SELECT rel_path AS path, doc_id, pos, substr(text, pos * 512 + 1, 512) AS chunk, length(substr(text, pos * 512 + 1, 512)) AS length, sha256(substr(text, pos * 512 + 1, 512)) AS hash
  FROM tree, unnest(range(0, (length(text) + 511) // 512)) AS u(pos))"""
MANIFESTS = "manifests AS (SELECT path, min(doc_id) AS doc_id, list(hash ORDER BY pos) AS hashes, count(*) AS n_chunks, sum(length)::BIGINT AS file_size FROM chunks GROUP BY path)"


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return cas.fixed_chunks(load(spark, d, "tree").select(F.col("rel_path").alias("path"), "text"), 512, content="text")


@query(f"WITH {CHUNKS} SELECT path, pos, pos * 512 AS \"offset\", length, hash FROM chunks", "tree")
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk_rows(spark, d).select("path", F.col("pos").cast("long").alias("pos"), "offset", "length", "hash")


@query(f"WITH {CHUNKS} SELECT sum(n)::BIGINT AS n_chunks, count(*) AS n_distinct, sum(n * length)::BIGINT AS total_length, sum(length)::BIGINT AS stored_length FROM (SELECT hash, count(*) AS n, max(length) AS length FROM chunks GROUP BY hash)", "tree")
def dedup_report(spark: SparkSession, d: str) -> DataFrame:
    return cas.dedup_report(chunk_rows(spark, d))


@query(f"WITH {CHUNKS}, {MANIFESTS} SELECT path, array_to_string(hashes, chr(10)) AS chunks, n_chunks, file_size FROM manifests", "tree")
def manifest_build(spark: SparkSession, d: str) -> DataFrame:
    return cas.manifests(chunk_rows(spark, d)).select("path", F.array_join("chunks", "\n").alias("chunks"), "n_chunks", "file_size")


@query("SELECT rel_path AS path, length(text) AS n_chars, hash, true AS size_ok, true AS hash_ok FROM tree", "tree")
def reassemble_check(spark: SparkSession, d: str) -> DataFrame:
    """Manifests to chunks and back: every file must come out as it went in, by its own digest."""
    chunks = chunk_rows(spark, d)
    built = cas.reassemble(cas.manifests(chunks), chunks.groupBy("hash").agg(F.first("chunk").alias("chunk")))
    expected = load(spark, d, "tree").select(F.col("rel_path").alias("path"), F.col("size").alias("file_size"), F.col("hash").alias("file_hash"))
    sums = built.select("path", F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("hash"))
    return sums.join(cas.integrity(built, expected), "path")


@query(f"""WITH {CHUNKS}, declared AS (SELECT rel_path AS path, octet_length(encode(text)) AS bytes, octet_length(encode(text)) + CASE WHEN doc_id % 5 = 2 THEN -1 WHEN doc_id % 5 = 3 THEN 1 ELSE 0 END AS file_size, doc_id % 11 = 4 AS other_hash FROM tree),
run AS (SELECT path, pos, hash, octet_length(encode(chunk)) AS n, sum(octet_length(encode(chunk))) OVER (PARTITION BY path ORDER BY pos) AS upto FROM chunks),
faults AS (SELECT path, pos, upto - n AS before, CASE WHEN hash LIKE '1%' THEN 'missing' WHEN hash LIKE '0%' THEN 'chunk' WHEN upto > file_size THEN 'overrun' END AS fault FROM run JOIN declared USING (path)),
first AS (SELECT path, min(pos) AS "at", arg_min(fault, pos) AS fault, arg_min(before, pos) AS before FROM faults WHERE fault IS NOT NULL GROUP BY path)
SELECT d.path, coalesce(before, bytes)::BIGINT AS n_bytes, coalesce(fault, CASE WHEN bytes <> file_size THEN 'size' WHEN other_hash THEN 'hash' END) AS fault, "at" FROM declared d LEFT JOIN first USING (path)""", "tree")
def hydrate_faults(spark: SparkSession, d: str) -> DataFrame:
    """Files over a store with absent and altered chunks, of which some declare a wrong size or hash."""
    chunks, k = chunk_rows(spark, d), F.col("doc_id")
    declared = load(spark, d, "tree").select(F.col("rel_path").alias("path"), (F.octet_length("text") + F.when(k % 5 == 2, -1).when(k % 5 == 3, 1).otherwise(0)).alias("file_size"), F.when(k % 11 == 4, "x").otherwise(F.col("hash")).alias("file_hash"))
    manifests = declared.join(cas.manifests(chunks).select("path", "chunks"), "path", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>")))
    store = chunks.groupBy("hash").agg(F.first("chunk").alias("chunk")).where("hash NOT LIKE '1%'").withColumn("chunk", F.when(F.col("hash").startswith("0"), F.concat("chunk", F.lit("x"))).otherwise(F.col("chunk")))
    return cas.hydrate(manifests, store).select("path", "n_bytes", "fault", "at")


@query(f"""WITH {CHUNKS}, frames AS (SELECT path, pos, length, sum(length) OVER (PARTITION BY path ORDER BY pos) - length AS "begin" FROM chunks),
asked AS (SELECT rel_path AS path, doc_id, doc_id % 900 AS start, doc_id % 900 + CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 600 WHEN 2 THEN 5000 ELSE 1 END AS stop FROM tree)
SELECT doc_id, pos, "begin"::BIGINT AS "begin" FROM asked a JOIN frames f ON f.path = a.path AND f."begin" < a.stop AND f."begin" + f.length > a.start WHERE a.start < a.stop""", "tree")
def requested_frames(spark: SparkSession, d: str) -> DataFrame:
    """A request for a range of every file, of which some are empty and some pass the file's end."""
    k = F.col("doc_id")
    frames = cas.frame_offsets(chunk_rows(spark, d).select("path", "pos", F.col("length").alias("uncompressed"), F.col("length").alias("compressed")))
    size = F.when(k % 4 == 0, 0).when(k % 4 == 1, 600).when(k % 4 == 2, 5000).otherwise(1)
    asked = load(spark, d, "tree").select(F.col("rel_path").alias("path"), "doc_id", (k % 900).alias("start"), (k % 900 + size).alias("end"))
    return cas.requested_frames(frames, asked).select("doc_id", F.col("pos").cast("long").alias("pos"), "begin")


_STORE = f"{CHUNKS}, objects AS (SELECT hash, max(CASE WHEN doc_id % 17 = 0 THEN NULL ELSE doc_id * 600 END) AS last_modified FROM chunks GROUP BY hash), used AS (SELECT DISTINCT hash FROM chunks WHERE doc_id % 9 <> 0)"


def _store(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    body = load(spark, d, "tree").select(F.concat_ws("|", "rel_path", "doc_id").alias("path"), "text")
    chunks = cas.fixed_chunks(body, 512, content="text").withColumn("doc_id", F.substring_index("path", "|", -1).cast("long"))
    objects = chunks.groupBy("hash").agg(F.max(F.when(F.col("doc_id") % 17 != 0, F.col("doc_id") * 600)).alias("last_modified"))
    kept = chunks.where("doc_id % 9 <> 0")
    return objects, cas.reachable(cas.manifests(kept))


@query(f"WITH {_STORE} SELECT hash, last_modified FROM objects WHERE hash NOT IN (SELECT hash FROM used)", "tree")
def orphan_chunks(spark: SparkSession, d: str) -> DataFrame:
    return cas.orphans(*_store(spark, d))


@query(f"WITH {_STORE} SELECT count(*) AS scanned, count(u.hash) AS referenced, count(*) - count(u.hash) AS orphaned FROM objects o LEFT JOIN used u ON o.hash = u.hash", "tree")
def orphan_report(spark: SparkSession, d: str) -> DataFrame:
    return cas.orphan_report(*_store(spark, d))


@query(f"WITH {_STORE} SELECT hash, last_modified, CASE WHEN last_modified IS NULL THEN 'skip' WHEN 400000 - last_modified >= 86400 THEN 'delete' ELSE 'within_grace' END AS plan FROM objects WHERE hash NOT IN (SELECT hash FROM used)", "tree")
def orphan_cleanup_plan(spark: SparkSession, d: str) -> DataFrame:
    return cas.cleanup_plan(cas.orphans(*_store(spark, d)), 400_000, cas.grace(3600))


@query("""SELECT o_orderkey AS hash, CASE WHEN o_orderkey % 5 = 0 THEN 'already_gone' WHEN o_orderkey % 4 = 0 OR 1000000 - o_orderkey * 60 < 86400 THEN 'within_grace' WHEN o_orderkey % 7 = 0 THEN 'not_deletable' ELSE 'ready' END AS readiness FROM orders""")
def delete_readiness(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.sources.tables import read_table

    k = F.col("o_orderkey")
    rows = read_table(spark, d, "orders").select(k.alias("hash"), (k * 60 - F.when(k % 4 == 0, 1).otherwise(0)).alias("scanned"), F.when(k % 5 != 0, k * 60).alias("fresh"), F.when(k % 7 != 0, k.cast("string")).alias("version"))
    return cas.delete_readiness(rows, 1_000_000, 86_400).select("hash", "readiness")


@query("""SELECT profile, count(*) AS n, sum(size)::BIGINT AS bytes FROM (SELECT size, CASE WHEN regexp_matches(path, '(^|/)\\.git/index$') THEN 'pack' WHEN regexp_matches(path, '\\.git/objects/pack/[^/]*\\.idx$') THEN 'large'
  WHEN regexp_matches(path, '[^/]\\.(pack|rev|iso|img)$') THEN 'large' WHEN regexp_matches(path, '[^/]\\.(idx|bin)$') THEN 'pack' ELSE 'small' END AS profile FROM inventory) GROUP BY profile""", "inventory")
def profile_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "inventory").groupBy(paths.chunk_profile(F.col("path")).alias("profile")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("""SELECT doc_id, CASE WHEN state = 'committed' AND (doc_id % 6 = 1 OR doc_id % 8 = 2) THEN 'committed_needs_current_only' WHEN state = 'deleted' AND (doc_id % 6 <> 1 OR doc_id % 8 = 2) THEN 'deleted_has_entry'
  WHEN (doc_id % 5 = 0) <> (state = 'deleted') THEN 'version_4_means_deleted' WHEN doc_id % 7 = 0 AND doc_id % 4 = 1 AND doc_id % 5 <> 0 THEN 'symlink_needs_version_3' END AS fault FROM remote_side""", "remote_side")
def index_faults(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    rows = load(spark, d, "remote_side").select("doc_id", "state", (k % 6 != 1).alias("has_current"), (k % 8 == 2).alias("has_pending"), F.when(k % 5 == 0, 4).when(k % 4 == 1, 2).otherwise(3).alias("version"), F.when(k % 7 == 0, "symlink").otherwise("regular_file").alias("kind"))
    return cas.index_faults(rows).select("doc_id", "fault")


@query("""SELECT t.rel_path, CASE WHEN r.rel_path IS NULL THEN 'missing_index' WHEN t.doc_id % 11 = 0 THEN 'parse_error' WHEN t.doc_id % 6 = 1 THEN 'preparing_only' WHEN r.state = 'deleted' THEN 'no_visible_entry' WHEN t.doc_id % 9 = 0 THEN 'missing_manifest' ELSE 'visible' END AS status
FROM tree t LEFT JOIN remote_side r ON t.rel_path = r.rel_path""", "tree remote_side")
def index_inspect(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    remote = load(spark, d, "remote_side")
    index = remote.select("rel_path", F.when(k % 6 == 1, "preparing").otherwise(F.col("state")).alias("state"), "manifest_key", (k % 11 != 0).alias("parsed"))
    return cas.inspect_index(load(spark, d, "tree").select("rel_path"), index, remote.where("doc_id % 9 <> 0").select("manifest_key"))


@query("SELECT rel_path, manifest_key FROM remote_side WHERE state = 'committed'", "remote_side")
def visible_index(spark: SparkSession, d: str) -> DataFrame:
    """Every visible entry has its manifest, or the scan fails."""
    remote = load(spark, d, "remote_side")
    return cas.visible_entries(remote.select("rel_path", "state", "manifest_key"), remote.select("manifest_key"))


@query("""SELECT rel_path, CASE WHEN doc_id % 3 = 0 THEN 'commit_final' WHEN doc_id % 4 = 0 THEN 'commit_staged' ELSE 'error' END AS recovery FROM remote_side""", "remote_side")
def recover_pending(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "remote_side")
    ok = lambda n: r.select(F.col("manifest_key").alias("key"), (F.col("doc_id") % n == 0).alias("ok"))
    return cas.recover_pending(r.select("rel_path", "manifest_key", F.col("manifest_key").alias("staged_key")), ok(3), ok(4))


@query("""SELECT rel_path, CASE WHEN doc_id % 12 = 0 THEN 'missing_manifest' WHEN doc_id % 7 = 0 THEN 'kind' WHEN doc_id % 5 = 1 THEN 'size' WHEN doc_id % 11 = 3 THEN 'chunks' WHEN doc_id % 9 = 2 THEN 'path' END AS fault FROM tree""", "tree")
def binding_faults(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    t = load(spark, d, "tree")
    index = t.select("rel_path", F.col("rel_path").alias("manifest_key"), F.lit("regular_file").alias("kind"), F.col("size").alias("file_size"), F.lit(1).alias("n_chunks"))
    stored = t.where("doc_id % 12 <> 0").select(F.col("rel_path").alias("manifest_key"), F.when(k % 7 == 0, "symlink").otherwise("regular_file").alias("kind"), F.when(k % 5 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("file_size"), F.when(k % 11 == 3, 2).otherwise(1).alias("n_chunks"), F.when(k % 9 == 2, "elsewhere").otherwise(F.col("rel_path")).alias("rel_path"))
    return cas.binding_faults(index, stored)


@query("""SELECT rel_path AS key, CASE WHEN doc_id % 10 = 0 THEN 'bypass' WHEN doc_id % 7 = 0 THEN 'fetch' WHEN doc_id % 11 = 0 THEN 'evict_and_refetch' ELSE 'hit' END AS decision FROM tree""", "tree")
def cached_hydrate(spark: SparkSession, d: str) -> DataFrame:
    wanted = load(spark, d, "tree").select(F.col("rel_path").alias("key"), F.when(F.col("doc_id") % 10 == 0, 1).otherwise(2).alias("version"), F.col("hash").alias("file_hash"))
    return cas.cached_hydrate(wanted, load(spark, d, "local_side").select(F.col("rel_path").alias("key"), "hash"))


@query(f"""WITH {CHUNKS} SELECT path, pos, coalesce(sum(length) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "begin" FROM chunks""", "tree")
def frame_offsets(spark: SparkSession, d: str) -> DataFrame:
    frames = chunk_rows(spark, d).select("path", "pos", F.col("length").alias("uncompressed"), F.col("length").alias("compressed"))
    return cas.frame_offsets(frames).select("path", F.col("pos").cast("long").alias("pos"), "begin")


@query(f"""WITH {CHUNKS} SELECT path, pos FROM chunks WHERE pos * 512 < 1500 AND pos * 512 + length > 700""", "tree")
def range_frames(spark: SparkSession, d: str) -> DataFrame:
    frames = chunk_rows(spark, d).select("path", "pos", F.col("length").alias("uncompressed"), F.col("length").alias("compressed"))
    return cas.overlapping_frames(frames, F.lit(700), F.lit(1500)).select("path", F.col("pos").cast("long").alias("pos"))


def _profiled(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "tree").select(F.col("rel_path").alias("path"), "text", paths.chunk_profile(F.col("rel_path")).alias("profile"))


@query()
def cdc_chunks(spark: SparkSession, d: str) -> DataFrame:
    return cas.content_chunks(_profiled(spark, d), content="text")


def _rejoined(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each file's bytes put together again from its chunks' places, and how many of their hashes hold."""
    body = F.col("text").cast("binary")
    part = F.substr(body, F.col("offset").cast("int") + 1, F.col("length").cast("int"))
    rows = files.join(chunks, "path").select("path", "pos", "length", part.alias("part"), (F.sha2(part, 256) == F.col("hash")).alias("ok"))
    return rows.groupBy("path").agg(F.sum("length").alias("n_bytes"), F.sha2(F.expr("listagg(part) WITHIN GROUP (ORDER BY pos)"), 256).alias("hash"), (F.count_if("ok") == F.count("*")).alias("hashes_hold"))


@query("SELECT rel_path AS path, octet_length(encode(text))::BIGINT AS n_bytes, hash, true AS hashes_hold FROM tree WHERE text <> ''", "tree")
def cdc_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Chunks cover each file once and in order."""
    files = _profiled(spark, d)
    return _rejoined(files, cas.content_chunks(files, content="text"))


@query("SELECT rel_path AS path, octet_length(encode(text))::BIGINT AS n_bytes, hash, true AS hashes_hold FROM tree WHERE text <> ''", "tree")
def cdc_blocks_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The same from files that come as blocks of 700 characters."""
    files = _profiled(spark, d)
    blocks = cas.fixed_chunks(files.select("path", "text"), 700, content="text").join(files.select("path", "profile"), "path")
    return _rejoined(files, cas.block_chunks(blocks, block="pos", content="chunk"))


@query("SELECT rel_path AS path, octet_length(encode(text))::BIGINT AS n_bytes, hash, true AS hashes_hold FROM tree WHERE text <> ''", "tree")
def cdc_sql_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """H04 from SQL text: a table function over each file's blocks in their order."""
    files = _profiled(spark, d)
    blocks = cas.fixed_chunks(files.select("path", "text"), 700, content="text").join(files.select("path", "profile"), "path")
    cas.register_chunker(spark)
    blocks.select("path", F.col("pos").alias("block"), F.col("chunk").alias("content"), "profile").createOrReplaceTempView("blocks_of_files")
    return _rejoined(files, spark.sql("SELECT * FROM block_chunks(TABLE(blocks_of_files) PARTITION BY path ORDER BY block)"))


@query("SELECT rel_path AS path, octet_length(encode(text))::BIGINT AS n_bytes, substring(hash, 1, 64) AS hash FROM tree WHERE text <> ''", "tree")
def seekable_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Compress to frames and read everything back: the digest of what was read must be the file's."""
    frames = cas.compress_frames(load(spark, d, "tree").select(F.col("rel_path").alias("path"), "text"), frame_bytes=4096, content="text")
    whole = cas.read_range(frames, 0)
    return whole.select("path", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("hash"))


@query("SELECT rel_path AS path, lower(hex(encode(text)[5001:6000])) AS content FROM tree WHERE octet_length(encode(text)) > 5000", "tree")
def range_read(spark: SparkSession, d: str) -> DataFrame:
    frames = cas.compress_frames(load(spark, d, "tree").select(F.col("rel_path").alias("path"), "text"), frame_bytes=4096, content="text")
    return cas.read_range(frames, 5000, 6000).select("path", F.lower(F.hex("content")).alias("content"))


@query(f"WITH {CHUNKS} SELECT path, pos, hash AS opened FROM chunks", "tree")
def gcm_chunks(spark: SparkSession, d: str) -> DataFrame:
    secret = F.lit("0123456789abcdef").cast("binary")
    opened = cas.decrypt_chunks(cas.encrypt_chunks(chunk_rows(spark, d), secret), secret)
    return opened.select("path", F.col("pos").cast("long").alias("pos"), F.sha2("opened", 256).alias("opened"))


@query()
def seek_tables(spark: SparkSession, d: str) -> DataFrame:
    frames = cas.compress_frames(load(spark, d, "tree").select(F.col("rel_path").alias("path"), "text"), frame_bytes=4096, content="text")
    return cas.seek_table(frames)
