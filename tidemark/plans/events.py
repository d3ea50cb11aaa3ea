"""Change events in batch and as streams, and the sources and sinks, over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import clocks, ingress, paths
from tidemark.operators import cas
from tidemark.operators.checkpoints import work_folder
from tidemark.plans.catalog import query
from tidemark.plans.fixtures import load
from tidemark.sources import tables
from tidemark.streaming import events as ev

GAP = 3600
_FS = "fs AS (SELECT concat('u', user_id::VARCHAR) AS path, epoch_us(ts) AS ts_micros, event_id AS seq, event_type AS kind FROM events)"
_PERIODS = f"""WITH {_FS}, m AS (SELECT *, CASE WHEN ts_micros - lag(ts_micros) OVER (PARTITION BY path ORDER BY ts_micros, seq) < {GAP}000000 THEN 0 ELSE 1 END AS new FROM fs),
p AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts_micros, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS period FROM m)
SELECT path, min(ts_micros) AS started, max(ts_micros) AS ended, count(*) AS n, arg_max(kind, seq) AS kind FROM p GROUP BY path, period"""


def _fs(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read_table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), ts.alias("ts"), F.unix_micros(ts).alias("ts_micros"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))


@query(_PERIODS)
def debounce(spark: SparkSession, d: str) -> DataFrame:
    return ev.debounce(_fs(spark, d).drop("ts"), GAP * 1_000_000)


@query(f"SELECT path, started, ended, n FROM ({_PERIODS})")
def debounce_windows(spark: SparkSession, d: str) -> DataFrame:
    w = ev.debounce_windows(_fs(spark, d), f"{GAP} seconds")
    return w.select("path", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n")


@query(f"SELECT path, started, ended, n FROM ({_PERIODS})")
def debounce_stream(spark: SparkSession, d: str) -> DataFrame:
    """ST01 as a stream: what is there is processed and written once the run ends (complete mode)."""
    source, out = work_folder(spark, "fs-events"), work_folder(spark, "periods")
    _fs(spark, d).write.parquet(source)
    stream = ev.stream_table(spark, source, "path string, ts timestamp, ts_micros long, seq long, kind string")
    found = ev.debounce_windows(stream, f"{GAP} seconds")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.select("path", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n").write.mode("overwrite").parquet(out)

    found.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", work_folder(spark, "cursor")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


_LATEST = "SELECT rel_path, arg_max(type, seq) AS type, arg_max(device_id, seq) AS device_id, max(seq) AS seq FROM log_events WHERE device_id <> 'dev3' AND rel_path IS NOT NULL AND rel_path NOT LIKE '%/.ssh/%' GROUP BY rel_path"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "log_events").select("seq", "device_id", "type", "rel_path")


@query("SELECT seq, device_id, type, rel_path FROM log_events WHERE device_id <> 'dev3' AND NOT (type IN ('file_synced', 'file_deleted', 'file_renamed', 'conflict_resolved') AND coalesce(rel_path, '') LIKE '%/.ssh/%')", "log_events")
def event_ingress(spark: SparkSession, d: str) -> DataFrame:
    return ev.accepted(_log(spark, d), "dev3")


@query(_LATEST, "log_events")
def replay_latest(spark: SparkSession, d: str) -> DataFrame:
    return ev.latest_by_path(ev.accepted(_log(spark, d), "dev3").where("rel_path IS NOT NULL"))


@query(_LATEST, "log_events")
def replay_stream(spark: SparkSession, d: str) -> DataFrame:
    """ST02, ST04, ST09: the log as files of JSON bodies, each micro-batch decoded, filtered and written
    to its own folder, then the latest event of each path."""
    source, out = work_folder(spark, "log"), work_folder(spark, "replayed")
    bodies = _log(spark, d).withColumn("part", F.pmod("seq", F.lit(4)))
    bodies.select("part", "seq", F.to_json(F.struct("device_id", "type", "rel_path")).alias("value")).repartition(4, "part").write.parquet(source)
    stream = ev.stream_table(spark, source, "part long, seq long, value string")
    write = ev.idempotent_writer(out)

    def replay(batch: DataFrame, batch_id: int) -> None:
        decoded = ev.decode(batch.select("seq", "value")).select("seq", "device_id", "type", "rel_path")
        write(ev.accepted(decoded, "dev3").where("rel_path IS NOT NULL"), batch_id)

    ev.run_available(stream, work_folder(spark, "cursor"), replay)
    return ev.latest_by_path(spark.read.parquet(out).drop("batch"))


@query("SELECT seq, device_id, type FROM log_events WHERE seq % 3 = 1", "log_events")
def ephemeral_stream(spark: SparkSession, d: str) -> DataFrame:
    """Only what arrives after the consumer has started."""
    source, out, cursor = work_folder(spark, "ephemeral"), work_folder(spark, "arrived"), work_folder(spark, "cursor")
    log = _log(spark, d).select("seq", "device_id", "type")
    log.where("seq % 3 <> 1").write.parquet(source)
    stream = ev.skip_backlog(spark, source, "seq long, device_id string, type string", cursor)
    log.where("seq % 3 = 1").write.mode("append").parquet(source)
    ev.run_available(stream, cursor, ev.idempotent_writer(out))
    return spark.read.schema("seq long, device_id string, type string, batch long").parquet(out).drop("batch")


@query("SELECT device_id, count(*) AS n, max(seq) AS last_seq FROM log_events GROUP BY device_id", "log_events")
def periodic_stream(spark: SparkSession, d: str) -> DataFrame:
    """ST11: a query on a timer, stopped once it has taken what is there."""
    source, out = work_folder(spark, "periodic"), work_folder(spark, "ticks")
    _log(spark, d).select("seq", "device_id").write.parquet(source)
    running = ev.run_every(ev.stream_table(spark, source, "seq long, device_id string"), work_folder(spark, "cursor"), ev.idempotent_writer(out), 1)
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.parquet(out).groupBy("device_id").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


_STATE = "state_entries AS (SELECT rel_path AS path, hash, size, mtime, status, remote_path FROM tracked)"


@query(f"WITH {_STATE} SELECT path, hash, size, mtime, status, remote_path, '' AS device_id FROM state_entries", "tracked")
def state_scan(spark: SparkSession, d: str) -> DataFrame:
    """State files of a few entries each, half of them in the older plain form, read back as rows."""
    entry = F.struct("hash", "size", "mtime", "remote_path", "status")
    files = load(spark, d, "tracked").groupBy(F.floor(F.col("doc_id") / 20).alias("file")).agg(F.map_from_entries(F.collect_list(F.struct("rel_path", entry))).alias("entries"))
    body = F.when(F.col("file") % 2 == 0, F.to_json(F.struct(F.col("file").alias("last_seq"), F.lit("me").alias("device_id"), "entries"))).otherwise(F.to_json("entries"))
    return tables.scan_state(files.select(body.alias("content"))).select("path", "hash", "size", "mtime", "status", "remote_path", "device_id")


@query("SELECT rel_path, hash, status FROM tracked", "tracked")
def state_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """One version of the state, whatever is written after it."""
    out = work_folder(spark, "state")
    rows = load(spark, d, "tracked").select("rel_path", "hash", "status")
    tables.write_state(rows, out, 1)
    tables.write_state(rows.withColumn("status", F.lit("changed")), out, 2)
    return tables.read_state(spark, out, 1)


@query("SELECT type, device_id, count(*) AS n FROM log_events GROUP BY type, device_id", "log_events")
def counters_stream(spark: SparkSession, d: str) -> DataFrame:
    """A12 as a stream in complete mode."""
    from tidemark.operators import metrics

    source, out = work_folder(spark, "counted"), work_folder(spark, "counters")
    _log(spark, d).write.parquet(source)
    counted = metrics.counters(ev.stream_table(spark, source, "seq long, device_id string, type string, rel_path string"), "type", "device_id")
    counted.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", work_folder(spark, "cursor")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("""SELECT e.seq, e.rel_path, e.type, CASE WHEN i.rel_path IS NULL THEN 'missing' WHEN i.state = 'deleted' THEN 'deleted' ELSE 'live' END AS "now" FROM log_events e LEFT JOIN (SELECT rel_path, CASE WHEN max(seq) % 3 = 0 THEN 'deleted' ELSE 'committed' END AS state FROM log_events WHERE rel_path IS NOT NULL AND seq % 5 = 0 GROUP BY rel_path) i ON i.rel_path = e.rel_path WHERE e.rel_path IS NOT NULL""", "log_events")
def watch_stream(spark: SparkSession, d: str) -> DataFrame:
    """ST10: two event streams merged and rebound to the index by a stream-static join."""
    from tidemark.operators import namespace

    a, b, out = work_folder(spark, "watch-a"), work_folder(spark, "watch-b"), work_folder(spark, "watched")
    e = _log(spark, d).where("rel_path IS NOT NULL").select("seq", "rel_path", "type")
    e.where("seq % 2 = 0").write.parquet(a)
    e.where("seq % 2 = 1").write.parquet(b)
    index = e.where("seq % 5 = 0").groupBy("rel_path").agg(F.max("seq").alias("_s")).select("rel_path", F.when(F.col("_s") % 3 == 0, "deleted").otherwise("committed").alias("state"), F.col("rel_path").alias("manifest_key"))
    schema = "seq long, rel_path string, type string"
    merged = ev.stream_table(spark, a, schema).unionByName(ev.stream_table(spark, b, schema))
    ev.run_available(namespace.rebind_events(merged, index).drop("manifest_key"), work_folder(spark, "cursor"), ev.idempotent_writer(out))
    return spark.read.parquet(out).drop("batch")


@query("WITH r AS (SELECT event_id AS seq, epoch_us(ts) // 1000000 AS ts FROM events), e AS (SELECT max(seq) AS m, max(ts) AS t FROM r) SELECT seq FROM r, e WHERE m - seq < 500 AND t - ts <= 604800")
def retention_filter(spark: SparkSession, d: str) -> DataFrame:
    log = _fs(spark, d).select("seq", F.floor(F.col("ts_micros") / 1_000_000).alias("ts"))
    now = log.agg(F.max("ts").alias("t")).first().t
    return ev.retained(log, now, 7 * 86_400, 500).select("seq")


@query("""WITH s AS (SELECT device_id AS device, seq, event_type NOT IN ('error', 'view') AS ok FROM log_events), r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY device ORDER BY seq) AS run FROM s), f AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY device, run ORDER BY seq) AS failures FROM r)
SELECT device, seq, ok, failures::BIGINT AS failures, CASE WHEN NOT ok AND failures % 5 = 0 THEN (300 * power(2, failures / 5 - 1))::BIGINT ELSE 0 END AS lockout_seconds FROM f""", "log_events")
def lockout_log(spark: SparkSession, d: str) -> DataFrame:
    return ev.lockout_log(load(spark, d, "log_events").select(F.col("device_id").alias("device"), "seq", (~F.col("event_type").isin("error", "view")).alias("ok")))


@query()
def rate_limit_stream(spark: SparkSession, d: str) -> DataFrame:
    """ST06 with keyed state on a stream: failures in a row and the end of the lockout, by device."""
    source, out = work_folder(spark, "attempts"), work_folder(spark, "limits")
    load(spark, d, "log_events").select(F.col("device_id").alias("device"), F.col("seq").alias("ts"), (~F.col("event_type").isin("error", "view")).alias("ok")).write.parquet(source)
    stream = ev.stream_table(spark, source, "device string, ts long, ok boolean")
    limited = stream.groupBy("device").transformWithStateInPandas(ev.rate_limit_state(), "device string, failures long, locked_until long", "Update", "None")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # the session's own setting comes back
        limited.writeStream.outputMode("update").foreachBatch(ev.idempotent_writer(out)).option("checkpointLocation", work_folder(spark, "cursor")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(out).groupBy("device").agg(F.max_by("failures", "batch").alias("failures"), F.max_by("locked_until", "batch").alias("locked_until"))


@query("""WITH a AS (SELECT event_id, concat('u', user_id::VARCHAR) AS path, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1) % 4 AS attempt, event_type = 'error' AS failed FROM events),
d AS (SELECT *, 1000 * power(2, attempt)::BIGINT AS delay FROM a)
SELECT event_id, attempt, CASE WHEN NOT failed THEN 'done' WHEN attempt >= 3 THEN 'dropped' ELSE 'retry' END AS next, CASE WHEN failed AND attempt < 3 THEN delay + (xor(length(path), attempt) * 2654435761) % (delay // 4) END AS delay_ms FROM d""")
def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")) - 1
    e = load(spark, d, "log_events").withColumn("attempt", (nth % 4).cast("long"))
    rows = e.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), "attempt", (F.col("event_type") == "error").alias("failed"))
    return ev.retry_schedule(rows).select("event_id", "attempt", "next", "delay_ms")


@query("SELECT doc_id, path LIKE '%.tc' OR list_has_any(string_split(path, '/'), ['.git', 'target', 'node_modules']) AS ignored FROM inventory", "inventory")
def watch_filter(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "inventory").select("doc_id", ev.watch_ignored(F.col("path")).alias("ignored"))


@query("""SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN 'drop' WHEN doc_id % 23 = 0 THEN 'no_ack' WHEN doc_id % 7 <> 0 AND size > 8000 THEN 'skip_size' WHEN doc_id % 10 = 7 THEN 'defer' WHEN doc_id % 4 <> 0 AND doc_id % 9 = 0 THEN 'record_conflict' WHEN doc_id % 4 = 0 THEN 'pull'
 WHEN doc_id % 6 = 0 THEN 'merge_clocks' WHEN ca > 2 AND cb >= 1 THEN 'skip_local_newer' WHEN ca <= 2 AND cb <= 1 AND (ca < 2 OR cb < 1) THEN 'pull' WHEN concat('dev', (doc_id % 3)::VARCHAR) <= 'dev1' THEN 'keep_local' ELSE 'keep_remote' END AS decision
FROM (SELECT doc_id, size, 1 + doc_id % 3 AS ca, doc_id % 2 AS cb FROM tree)""", "tree")
def pull_decision(spark: SparkSession, d: str) -> DataFrame:
    """ST03: the remote clock is (a: 2, b: 1); both-equal clocks with other content conflict."""
    k = F.col("doc_id")
    clock = lambda a, b: F.create_map(F.lit("a"), a, F.lit("b"), b).cast("map<string,bigint>")
    rows = load(spark, d, "tree").select(
        "doc_id", "size", (k % 29 != 0).alias("valid"), (k % 23 != 0).alias("indexed"), (k % 7 == 0).alias("is_git"), F.lit(8000).alias("size_limit"), F.when(k % 10 == 7, "active").otherwise("synced").alias("status"),
        F.when(k % 4 != 0, "h").alias("cached_hash"), F.when(k % 9 == 0, "edited").otherwise("h").alias("local_hash"), F.when(k % 6 == 0, "h").otherwise("other").alias("remote_hash"),
        clock(1 + k % 3, k % 2).alias("local_clock"), clock(F.lit(2), F.lit(1)).alias("remote_clock"), F.concat(F.lit("dev"), (k % 3).cast("string")).alias("device_id"), F.lit("dev1").alias("remote_device"),
    )
    return rows.select("doc_id", ev.pull_decision().alias("decision"))


@query(f"""WITH {_FS}, l AS (SELECT path, seq, ts_micros // 1000000 AS ts, kind <> 'error' AS found FROM fs), w AS (SELECT *, last_value(CASE WHEN NOT found THEN ts END IGNORE NULLS) OVER (PARTITION BY path ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS miss FROM l)
SELECT path, seq, coalesce(ts - miss < 7200, false) AS cached_miss FROM w""")
def negative_cache(spark: SparkSession, d: str) -> DataFrame:
    lookups = _fs(spark, d).select("path", "seq", F.floor(F.col("ts_micros") / 1_000_000).alias("ts"), (F.col("kind") != "error").alias("found"))
    return ev.negative_cache(lookups, 7200).select("path", "seq", "cached_miss")


@query("SELECT doc_id, concat('a:', greatest(1 + doc_id % 3, 2)::VARCHAR, ',b:', greatest(doc_id % 2, 1)::VARCHAR) AS merged, CASE WHEN doc_id % 4 = 0 THEN concat('a:', greatest(1 + doc_id % 3, 2)::VARCHAR, ',b:', greatest(doc_id % 2, 1)::VARCHAR, ',me:1') END AS dominating FROM tree", "tree")
def clock_after_effects(spark: SparkSession, d: str) -> DataFrame:
    """Merges after an upload, and after a fast-forward whose manifest is still the planned one."""
    k = F.col("doc_id")
    clock = lambda a, b: F.create_map(F.lit("a"), a, F.lit("b"), b).cast("map<string,bigint>")
    own, other = clock(1 + k % 3, k % 2), clock(F.lit(2), F.lit(1))
    dominated = clocks.dominate(own, other, F.lit("me"), F.lit("m"), F.when(k % 4 == 0, "m").otherwise("n"))
    return load(spark, d, "tree").select("doc_id", clocks.text(clocks.after_upload(own, other, F.lit(True))).alias("merged"), F.when(dominated.isNotNull(), clocks.text(dominated)).alias("dominating"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Index objects: JSON, the older text form, and directory markers."""
    k = F.col("doc_id")
    json = F.to_json(F.struct(F.lit(4).alias("version"), F.lit("committed").alias("state"), F.concat(F.lit("m"), k.cast("string")).alias("manifest_hash"), F.col("size"), F.lit(1).alias("chunks")))
    old = F.concat(F.lit("manifest_hash=m"), k.cast("string"), F.lit("\nsize="), F.col("size").cast("string"), F.lit("\nchunks=1"))
    t = load(spark, d, "tree")
    files = t.select(F.concat(F.lit("store/index/"), "rel_path").alias("key"), F.when(k % 3 == 0, old).otherwise(json).alias("content"))
    marks = t.where("doc_id % 50 = 0").select(F.concat(F.lit("store/index/empty/"), k.cast("string"), F.lit(f"/{ingress.DIRECTORY_MARKER}")).alias("key"), F.lit("type=directory\n").alias("content"))
    return files.unionByName(marks)


@query("SELECT rel_path, 'committed' AS state, concat('m', doc_id::VARCHAR) AS manifest_hash, size, 1::BIGINT AS chunks, 'regular_file' AS kind FROM tree", "tree")
def index_scan(spark: SparkSession, d: str) -> DataFrame:
    return tables.scan_index(_entries(spark, d), "store")


@query("SELECT concat('empty/', doc_id::VARCHAR) AS folder FROM tree WHERE doc_id % 50 = 0", "tree")
def empty_directories(spark: SparkSession, d: str) -> DataFrame:
    return tables.empty_dirs(_entries(spark, d), "store")


@query("SELECT rel_path, 'file' AS kind FROM tree UNION ALL SELECT concat('empty/', doc_id::VARCHAR), 'empty_dir' FROM tree WHERE doc_id % 50 = 0", "tree")
def namespace_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return tables.namespace_snapshot(_entries(spark, d), "store")


@query("SELECT hash AS name, max(doc_id) AS last_modified FROM tree GROUP BY hash", "tree")
def chunk_keys(spark: SparkSession, d: str) -> DataFrame:
    """S12"""
    objects = load(spark, d, "tree").groupBy(F.concat(F.lit("store/chunks/"), "hash").alias("key")).agg(F.max("doc_id").alias("last_modified"))
    return tables.scan_keys(objects, "store", "chunks")


@query("SELECT doc_id, doc_id % 6 IN (0, 1) AS safe FROM tree", "tree")
def key_components(spark: SparkSession, d: str) -> DataFrame:
    """V12 over safe names, paths, dots, control characters and nothing."""
    k, h = F.col("doc_id") % 6, F.col("hash")
    shaped = F.when(k == 0, h).when(k == 1, F.concat(h, F.lit(".."))).when(k == 2, F.concat(h, F.lit("/x"))).when(k == 3, "..").when(k == 4, F.concat(h, F.lit("\n"))).otherwise("")
    return load(spark, d, "tree").select("doc_id", paths.is_key_component(shaped).alias("safe"))


@query("SELECT doc_id, lower(hex(encode(text))) AS hex, length(text) AS n_chars FROM tree", "tree")
def hex_codec(spark: SparkSession, d: str) -> DataFrame:
    """To hex, and back to the text."""
    coded = load(spark, d, "tree").select("doc_id", cas.to_hex(F.col("text").cast("binary")).alias("hex"))
    return coded.select("doc_id", "hex", F.length(cas.from_hex(F.col("hex")).cast("string")).cast("long").alias("n_chars"))


@query("SELECT t.rel_path, CASE WHEN r.rel_path IS NULL THEN 'committed' ELSE 'conflict' END AS outcome FROM tree t LEFT JOIN remote_side r ON r.rel_path = t.rel_path", "tree remote_side")
def publish_fresh_plan(spark: SparkSession, d: str) -> DataFrame:
    staged = load(spark, d, "tree").select("rel_path", F.col("hash").alias("manifest_key"), F.col("doc_id").alias("seq"))
    return tables.publish_fresh(staged, load(spark, d, "remote_side").select("rel_path", F.col("doc_id").alias("seq"))).select("rel_path", "outcome")


@query("SELECT hash AS name, min(doc_id) AS last_modified FROM tree GROUP BY hash", "tree")
def manifest_keys(spark: SparkSession, d: str) -> DataFrame:
    objects = load(spark, d, "tree").groupBy(F.concat(F.lit("store/manifests/"), "hash").alias("key")).agg(F.min("doc_id").alias("last_modified"))
    return tables.scan_keys(objects, "store", "manifests")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS version, concat('h', doc_id::VARCHAR, ',x') AS chunks, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE rel_path END AS rel_path, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE size END AS file_size FROM tree", "tree")
def manifest_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    first = F.concat(F.lit("h"), k.cast("string"))
    json = tables.manifest_text(F.lit(2), F.col("hash"), F.col("size"), F.array(first, F.lit("x")), F.col("rel_path"))
    body = F.when(k % 3 == 0, F.concat(first, F.lit("\nx\n"))).otherwise(json)
    return load(spark, d, "tree").select("doc_id", tables.parse_manifest(body).alias("m")).select("doc_id", "m.version", F.array_join("m.chunks", ",").alias("chunks"), "m.rel_path", "m.file_size")


@query("SELECT concat('store/trash/', o_orderkey::VARCHAR, '-x/', path) AS key, CASE WHEN trashed_at IS NULL THEN NULL ELSE path END AS path, CASE WHEN trashed_at IS NULL THEN NULL ELSE o_orderkey END AS trashed_at, CASE WHEN trashed_at IS NULL THEN 'unreadable generation' END AS issue FROM (SELECT cast(trash_key AS BIGINT) AS o_orderkey, path, trashed_at FROM trash WHERE trashed_at IS NOT NULL) UNION ALL SELECT concat('store/trash/bad/', path), NULL, NULL, 'unreadable generation' FROM trash WHERE trashed_at IS NULL", "trash")
def trash_scan(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("trashed_at").isNull(), F.concat(F.lit("store/trash/bad/"), "path")).otherwise(F.concat(F.lit("store/trash/"), "trash_key", F.lit("-x/"), "path"))
    return tables.trash_keys(load(spark, d, "trash").select(key.alias("key")), "store")


@query("SELECT t.rel_path, CASE WHEN r.rel_path IS NULL AND t.doc_id % 4 = 0 THEN 'committed' WHEN r.rel_path IS NOT NULL AND t.doc_id % 4 <> 0 AND t.doc_id % 3 <> 0 THEN 'committed' ELSE 'conflict' END AS outcome FROM tree t LEFT JOIN remote_side r ON r.rel_path = t.rel_path", "tree remote_side")
def publish_plan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    staged = load(spark, d, "tree").select("rel_path", F.col("hash").alias("manifest_key"), F.when(k % 4 == 0, None).when(k % 3 == 0, k + 1).otherwise(k).alias("base_seq"), (k + 10).alias("seq"))
    index = load(spark, d, "remote_side").select("rel_path", k.alias("seq"))
    return tables.publish(staged, index).select("rel_path", "outcome")


@query("SELECT concat('old/', rel_path) AS key, concat('new/', rel_path) AS new_key, CASE WHEN doc_id % 3 = 0 THEN 'would_copy' WHEN doc_id % 5 = 0 THEN 'destination_conflict' ELSE 'already_exact' END AS outcome FROM tree", "tree")
def prefix_migration(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "tree")
    source = t.select(F.concat(F.lit("old/"), "rel_path").alias("key"), F.col("hash").alias("content"))
    target = t.where("doc_id % 3 <> 0").select(F.concat(F.lit("new/"), "rel_path").alias("key"), F.when(F.col("doc_id") % 5 == 0, "else").otherwise(F.col("hash")).alias("content"))
    return tables.migrate_prefix(source, target, "old", "new")


@query("SELECT rel_path, doc_id, hash FROM tree", "tree")
def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The index written by path buckets and read back."""
    out = work_folder(spark, "index")
    tables.write_index(load(spark, d, "tree").select("rel_path", "doc_id", "hash"), out)
    return spark.read.parquet(out).select("rel_path", "doc_id", "hash")


@query("""SELECT rel_path, CASE WHEN doc_id % 9 = 0 THEN 'second' WHEN doc_id % 7 = 0 THEN 'first' ELSE hash END AS hash, doc_id % 9 = 0 AND doc_id % 2 = 0 AS deleted FROM tree
UNION ALL SELECT concat('fresh/', doc_id::VARCHAR), 'first', false FROM tree WHERE doc_id % 7 = 0""", "tree")
def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two sets of changes into the touched buckets of an index, and the first one again, which changes nothing."""
    out, t = work_folder(spark, "index"), load(spark, d, "tree")
    columns = lambda rows, name, value, seq, gone: rows.select(name.alias("rel_path"), value.alias("hash"), F.when(gone, "deleted").otherwise("committed").alias("state"), F.lit(seq).cast("long").alias("seq"))
    rel, never = F.col("rel_path"), F.lit(False)
    tables.create_index(columns(t, rel, F.col("hash"), 1, never), out, buckets=16)
    seventh = t.where("doc_id % 7 = 0")
    first = columns(seventh, rel, F.lit("first"), 2, never).unionByName(columns(seventh, F.concat(F.lit("fresh/"), F.col("doc_id").cast("string")), F.lit("first"), 2, never))
    second = columns(t.where("doc_id % 9 = 0"), rel, F.lit("second"), 3, F.col("doc_id") % 2 == 0)
    version = 0
    for changes in (first, second, first):
        version = tables.upsert_index(out, changes, version)
    return spark.read.parquet(out).select("rel_path", "hash", (F.col("state") == "deleted").alias("deleted"))


@query("""SELECT folder, sync_mode, download_threshold FROM policies""".replace("policies", "(SELECT DISTINCT * FROM (SELECT * FROM policy_rows UNION ALL SELECT * FROM policy_overrides))"), "policy_rows policy_overrides")
def policy_flush(spark: SparkSession, d: str) -> DataFrame:
    """The policy table written as a version after an older one, and read back."""
    from tidemark.plans.fixtures import policies

    out, rows = work_folder(spark, "policies"), policies(spark, d)
    tables.write_state(rows.where("sync_mode <> 'never'"), out, 1)
    tables.write_state(rows, out, 2)
    return tables.read_state(spark, out, 2)


@query("SELECT DISTINCT hash, substr(hash, 1, 2) AS shard, length(text)::BIGINT AS length FROM tree", "tree")
def chunk_store(spark: SparkSession, d: str) -> DataFrame:
    """Distinct chunks in a store partitioned by the first digits of the hash."""
    out = work_folder(spark, "chunks")
    tables.write_chunks(load(spark, d, "tree").select("hash", F.col("text").alias("chunk"), F.length("text").cast("long").alias("length")), out)
    schema = "hash string, chunk string, length long, shard string"
    return spark.read.schema(schema).parquet(out).select("hash", "shard", "length")


@query("SELECT decision, count(*) AS n FROM (SELECT CASE WHEN path LIKE '%.sqlite' THEN 'snapshot' WHEN path LIKE '%/.env' THEN 'deny' ELSE 'allow' END AS decision FROM inventory) GROUP BY decision", "inventory")
def inventory_sink(spark: SparkSession, d: str) -> DataFrame:
    """Inventory rows and summary as JSON, the summary read back."""
    out = work_folder(spark, "inventory")
    p = F.col("path")
    rows = load(spark, d, "inventory").select("path", F.when(F.endswith(p, F.lit(".sqlite")), "snapshot").when(F.endswith(p, F.lit("/.env")), "deny").otherwise("allow").alias("decision"), paths.name(p).alias("reason"))
    tables.write_inventory(rows, out)
    return spark.read.schema("decision string, reason string, n long").json(f"{out}/summary").groupBy("decision").agg(F.sum("n").alias("n"))


@query("SELECT concat('STATE.', device_id, '.', type) AS subject, seq, type FROM log_events", "log_events")
def event_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Events encoded for the log and decoded again."""
    sent = ev.encode(_log(spark, d).withColumn("last_seq", F.col("seq")))
    return ev.decode(sent).select("subject", F.col("last_seq").alias("seq"), "type")
