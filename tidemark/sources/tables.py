"""Sources and sinks: S01-S09, S12, S13, S20, K01-K05, K08-K10."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ingress, paths
from tidemark.operators import checkpoints, folders, lifecycle, namespace
from tidemark.operators.checkpoints import kept

#: Manifest bytes as JSON; fields that older writers lack are null and get their default.
MANIFEST_SCHEMA = "version int, file_hash string, file_size bigint, chunks array<string>, vclock struct<clocks:map<string,bigint>>, written_by string, written_at bigint, rel_path string, mode bigint, mtime array<bigint>, kind string, symlink_target string"
INDEX_SCHEMA = "version int, state string, manifest_hash string, size bigint, chunks bigint, kind string, symlink_target string"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_tree(spark: SparkSession, root: str, content: bool = False, **rules) -> DataFrame:
    """Files below a root: rel_path, size, mtime (epoch seconds)[, content], without denied ones.

    Listing and reading are Spark's; without ``content`` only metadata is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/+", "/")
    cut = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z0-9]+:/+", "/")
    rows = found.select(F.substr(rel, F.length(cut) + 2).alias("rel_path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), *(["content"] if content else []))
    parent = F.regexp_extract("rel_path", r"^(.*)/[^/]*$", 1)
    descended = (parent == "") | ingress.component_reason(parent, **rules).isNull()  # no denied folder on the way
    return rows.where(descended & ingress.path_reason(F.col("rel_path"), F.lit(False), **rules).isNull())


def walk(entries: DataFrame, links: str = "skip", **rules) -> DataFrame:
    """What a walk over a listing (rel_path, kind: file, directory or symlink, target) collects, in order:
    (rel_path, kind) with kind file, symlink or empty_dir.

    A denied entry goes with all below it, and so does a link whose target has a security component.  Links
    are preserved as links, skipped, or followed: then one to a listed file counts as a file, the first link
    by path where several lead to one file.  A folder is walked once, under the first path in the order of the tree that leads to it:
    its own, or that of a link to it or to a folder above it (``_followed``).  Links to nothing, outside the listing or in
    a cycle are dropped.  A folder under which nothing was collected is an empty one."""
    if links not in ("skip", "preserve", "follow"):
        raise ValueError(links)
    path, parent = F.col("rel_path"), F.regexp_extract("rel_path", r"^(.*)/[^/]*$", 1)
    descended = (parent == "") | ingress.component_reason(parent, **rules).isNull()
    checkpoints.ensure(entries.sparkSession)  # the rules are applied once, whatever the policy reads
    kept = entries.where(descended & ingress.path_reason(path, F.col("kind") == "directory", **rules).isNull()).checkpoint()
    files = kept.where("kind = 'file'").select("rel_path", F.lit("file").alias("kind"))
    seen = kept.where(F.col("kind") == "symlink").where(ingress.security_reason(F.coalesce("target", F.lit(""))).isNull())
    if links == "preserve":
        files = files.unionByName(seen.select("rel_path", F.lit("symlink").alias("kind")))
    elif links == "follow":
        real = _real_targets(entries.where("kind = 'symlink'").select("rel_path", "target"))
        to_folder = checkpoints.kept(seen_links(entries, **rules).join(real, "rel_path").join(entries.where("kind = 'directory'").select(F.col("rel_path").alias("real")), "real").where(ingress.security_reason(F.col("real")).isNull()), "folder-links")
        if not to_folder.isEmpty():
            return _followed(entries, to_folder, real, **rules)
        seen = seen.drop("target").join(real.withColumnRenamed("real", "target"), "rel_path").where(ingress.security_reason(F.col("target")).isNull())
        first = seen.groupBy("target").agg(F.min("rel_path").alias("link"))
        files = files.unionByName(first.join(files.select(F.col("rel_path").alias("target")), "target").select(F.col("link").alias("rel_path"), F.lit("file").alias("kind")))
    full = files.select(F.explode(paths.ancestors(path)).alias("rel_path")).distinct()
    empty = kept.where("kind = 'directory'").select("rel_path").join(full, "rel_path", "left_anti")
    return files.unionByName(empty.select("rel_path", F.lit("empty_dir").alias("kind"))).orderBy("kind", "rel_path")


#: Links on one way that are put in at most, as file systems do.
LINK_ROUNDS = 40


def seen_links(entries: DataFrame, **rules) -> DataFrame:
    """Links (rel_path) whose own name is not denied and whose target has no security component."""
    named = ingress.path_reason(F.col("rel_path"), F.lit(False), **rules).isNull()
    return entries.where((F.col("kind") == "symlink") & named & ingress.security_reason(F.coalesce("target", F.lit(""))).isNull()).select("rel_path")


def _real_targets(links: DataFrame) -> DataFrame:
    """(rel_path, real): each link's target with all links on its way put in, one a round; those that a file system would
    give up on have no row: links in a cycle (they come to themselves or below), and chains of over LINK_ROUNDS links."""
    known = checkpoints.kept(links.where("target IS NOT NULL").select("rel_path", F.col("target").alias("real")), "targets")
    now = known
    for _ in range(LINK_ROUNDS):
        chain = F.concat(paths.ancestors(F.col("real")), F.array("real"))
        on_way = now.select("rel_path", "real", F.posexplode(chain).alias("depth", "prefix"))  # links alone, not the listing
        hit = on_way.join(known.select(F.col("rel_path").alias("prefix"), F.col("real").alias("to")), "prefix").groupBy("rel_path").agg(F.min_by(F.struct("prefix", "to"), "depth").alias("x"))
        hit = checkpoints.kept(hit.select("rel_path", "x.*"), "substitutions")
        if hit.isEmpty():
            return now
        put = F.coalesce(F.concat("to", F.substr("real", F.length("prefix") + 1)), F.col("real"))
        moved = checkpoints.kept(now.join(hit, "rel_path", "left").select("rel_path", put.alias("real")), "moved")
        cyclic = moved.where((F.col("real") == F.col("rel_path")) | F.startswith("real", F.concat("rel_path", F.lit("/")))).select("rel_path")
        now = moved.join(cyclic, "rel_path", "left_anti")
        if not cyclic.isEmpty():
            known = checkpoints.kept(known.join(cyclic, "rel_path", "left_anti"), "targets")
    return now.join(hit.select("rel_path"), "rel_path", "left_anti")


def _placed(rows: DataFrame, marks: DataFrame, path: str, into: str) -> DataFrame:
    """Rows with the path under which a walk meets them (null: never), given where marked folders (folder, at) are met."""
    near = folders.nearest_above(rows, marks, path)
    moved = F.concat("mark.at", F.substr(path, F.length("mark.folder") + 1))
    return rows.join(near, path, "left").withColumn(into, F.when(F.col("mark").isNull(), F.col(path)).otherwise(moved)).drop("mark")


def _followed(entries: DataFrame, to_folder: DataFrame, real: DataFrame, **rules) -> DataFrame:
    """``walk`` where links lead to folders (rel_path, real).

    The walk meets a folder under the least path, in the order of the tree, of all that lead to it: its parent's path and its name,
    or the path of a link to it.  These are found as shortest paths are: from the real paths, every round takes the least arrival
    of what the round before knows, until none changes.  Only folders that are met elsewhere than at their parent's
    path, or never (denied names), are marked; all others follow from the nearest mark above them."""
    path = F.col("rel_path")
    listed = checkpoints.kept(entries.withColumn("ok", ingress.path_reason(path, F.col("kind") == "directory", **rules).isNull()), "listed")
    never = listed.where("kind = 'directory' AND NOT ok").select(F.col("rel_path").alias("folder"), F.lit(None).cast("string").alias("at"))
    key = lambda c: F.replace(F.col(c), F.lit("/"), F.lit("\x00"))
    parent, name = F.regexp_extract("real", r"^(.*)/[^/]*$", 1), F.regexp_extract("real", r"([^/]*)$", 1)
    goals = to_folder.select("real").distinct().join(listed.where("ok").select(F.col("rel_path").alias("real"), "ok"), "real", "left").withColumns({"parent": parent, "name": name})
    marks, before = checkpoints.kept(never, "marks"), None
    while True:
        arrivals = _placed(to_folder.select("rel_path", "real"), marks, "rel_path", "at").where("at IS NOT NULL")
        least = arrivals.groupBy("real").agg(F.min_by("at", key("at")).alias("at"))
        own = _placed(goals, marks, "parent", "above").withColumn("own", F.when(F.col("ok"), F.when(F.col("parent") == "", F.col("name")).otherwise(F.concat("above", F.lit("/"), "name"))))
        better = own.join(least, "real").where(F.col("own").isNull() | (key("at") < key("own"))).select(F.col("real").alias("folder"), "at")
        marks = checkpoints.kept(never.join(better.select("folder"), "folder", "left_anti").unionByName(better), "marks")
        state = marks.agg(F.count("*"), F.sum(F.xxhash64("folder", "at").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    met = checkpoints.kept(_placed(listed.where("ok OR kind = 'directory'").select("rel_path", "kind"), marks, "rel_path", "at").where("at IS NOT NULL"), "met")
    files = met.where("kind = 'file'").select("at")
    links = met.where("kind = 'symlink'").join(seen_links(entries, **rules), "rel_path", "left_semi").join(real, "rel_path").where(ingress.security_reason(F.col("real")).isNull())
    first = links.join(listed.where("kind = 'file'").select(F.col("rel_path").alias("real")), "real").groupBy("real").agg(F.min_by("at", key("at")).alias("at")).select("at")
    found = files.unionByName(first).select(F.col("at").alias("path"), F.lit(True).alias("live"))
    both = found.unionByName(met.where("kind = 'directory'").select(F.col("at").alias("path"), F.lit(False).alias("live"))).groupBy("path").agg(F.bool_or("live").alias("live"))
    asked = folders.with_below(both, F.col("live"))
    return asked.where("live OR NOT has_below").select(F.col("path").alias("rel_path"), F.when(F.col("live"), "file").otherwise("empty_dir").alias("kind")).orderBy("kind", "rel_path")


def local_set(files: DataFrame) -> DataFrame:
    """Keyed by NFC path.  A path that two files share, two spellings of one case-folded path, and a file
    that is another's ancestor (case-folded) are errors when the plan runs."""
    keyed = files.withColumn("rel_path", paths.normalise(F.col("rel_path")))
    per = keyed.groupBy("rel_path").agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in keyed.columns if c != "rel_path"])).alias("_r")).withColumn("_fold", paths.casefold(F.col("rel_path")))
    spelled = per.groupBy("_fold").agg(F.count("*").alias("_spellings"))
    above = per.select(F.explode(paths.ancestors(F.col("_fold"))).alias("_fold")).distinct().withColumn("_above", F.lit(True))
    checked = per.join(spelled, "_fold").join(above, "_fold", "left")
    fails = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.col("rel_path")))
    sound = F.when(F.col("_n") > 1, fails("duplicate path")).when(F.col("_spellings") > 1, fails("paths that differ in case")).when(F.col("_above"), fails("a file is an ancestor")).otherwise(F.col("rel_path"))
    return checked.select(sound.alias("rel_path"), "_r.*")


#: A tracked entry as the state file has it; fields that older writers lack get their default.
STATE_ENTRY = "hash string, size bigint, mtime bigint, chunk_count bigint, remote_path string, last_synced bigint, vclock map<string,bigint>, device_id string, conflict string, status string"


def scan_state(content: DataFrame, body: str = "content") -> DataFrame:
    """All entries of state files (JSON text): path and its fields, last_seq and owner.

    A file is an object with ``entries``, or the older plain object of entries; anything else fails the scan."""
    named = lambda c: F.try_element_at(F.col("_file"), F.lit(c))
    files = content.select(F.from_json(F.col(body), "map<string,string>").alias("_file"))  # entries stay text until each is a row
    wrapped = named("entries").isNotNull()
    entries = F.when(F.col("_file").isNull(), F.raise_error(F.lit("unreadable state file")).cast("map<string,string>")).when(wrapped, F.from_json(named("entries"), "map<string,string>")).otherwise(F.col("_file"))
    seq, owner = F.when(wrapped, named("last_seq").cast("bigint")), F.when(wrapped, named("device_id"))
    rows = files.select(F.coalesce(seq, F.lit(0)).alias("last_seq"), F.coalesce(owner, F.lit("")).alias("owner"), F.explode(entries).alias("path", "_text"))
    entry = F.when(F.rlike("_text", F.lit(r"^\s*\{")), F.col("_text")).otherwise(F.raise_error(F.concat(F.lit("unreadable state entry: "), F.col("path"))))
    return rows.select("path", F.from_json(entry, STATE_ENTRY).alias("e"), "last_seq", "owner").select("path", "e.*", "last_seq", "owner").fillna({"device_id": "", "status": "not_synced"})


def write_state(rows: DataFrame, out: str, version: int) -> None:
    """Tracked entries (or policies) as one version of their own, which is never written again."""
    rows.write.mode("error").parquet(f"{out}/version={version}")


def read_state(spark: SparkSession, out: str, version: int) -> DataFrame:
    """Exactly one written version: no other stands in for it, nothing is repaired or written, and a version
    that is missing or cannot be read is an error."""
    return spark.read.parquet(f"{out}/version={version}")


def parse_manifest(content: Column) -> Column:
    """Manifest bytes: JSON if the trimmed text starts with ``{`` (malformed: null, never the old form),
    else one chunk hash a line (version 1)."""
    text = F.trim(content.cast("string"))
    json = F.from_json(text, MANIFEST_SCHEMA)
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    old = F.struct(F.lit(1).alias("version"), lines.alias("chunks"))
    return F.when(F.startswith(text, F.lit("{")), F.struct(json["version"].alias("version"), json["chunks"].alias("chunks"), json["file_hash"].alias("file_hash"), F.coalesce(json["file_size"], F.lit(0)).alias("file_size"), json["rel_path"].alias("rel_path"), F.coalesce(json["kind"], F.lit("regular_file")).alias("kind"))).otherwise(F.struct(old["version"].alias("version"), F.transform(old["chunks"], lambda x: F.trim(x)).alias("chunks"), F.lit(None).cast("string").alias("file_hash"), F.lit(0).cast("bigint").alias("file_size"), F.lit(None).cast("string").alias("rel_path"), F.lit("regular_file").alias("kind")))


def manifest_text(version: Column, file_hash: Column, file_size: Column, chunks: Column, rel_path: Column) -> Column:
    """Manifest JSON of a version."""
    return F.to_json(F.struct(version.alias("version"), file_hash.alias("file_hash"), file_size.alias("file_size"), chunks.alias("chunks"), rel_path.alias("rel_path")))


def parse_index(content: Column) -> Column:
    """Index entries: JSON, or the older ``key=value`` lines."""
    text = F.trim(content.cast("string"))
    json = F.from_json(text, INDEX_SCHEMA)
    old = F.str_to_map(text, F.lit("\n"), F.lit("="))
    pick = lambda k, kind="string": F.coalesce(json[k].cast(kind), F.try_element_at(old, F.lit(k)).cast(kind)).alias(k)
    return F.struct(F.coalesce(json["state"], F.lit("committed")).alias("state"), pick("manifest_hash"), pick("size", "bigint"), pick("chunks", "bigint"), F.coalesce(json["kind"], F.lit("regular_file")).alias("kind"))


def scan_index(entries: DataFrame, prefix: str, marker: str = ingress.DIRECTORY_MARKER) -> DataFrame:
    """Index objects (key, content) below a prefix: rel_path and the parsed entry.  A path that
    is not canonical or an entry without a manifest fails the whole scan."""
    rel = F.substr("key", F.lit(len(prefix) + len("/index/") + 1))
    rows = entries.where(F.startswith("key", F.lit(f"{prefix}/index/"))).select(rel.alias("rel_path"), parse_index(F.col("content")).alias("e")).where(paths.name(F.col("rel_path")) != marker)
    bad = paths.canonical_fault(F.col("rel_path")).isNotNull() | (F.col("e.manifest_hash").isNull() & (F.col("e.state") == "committed"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("unreadable index entry: "), F.col("rel_path")))).otherwise(F.col("rel_path"))
    return rows.select(checked.alias("rel_path"), "e.*")


def empty_dirs(entries: DataFrame, prefix: str, marker: str = ingress.DIRECTORY_MARKER) -> DataFrame:
    """Folders that markers keep."""
    rel = F.substr("key", F.lit(len(prefix) + len("/index/") + 1))
    return entries.where(F.startswith("key", F.lit(f"{prefix}/index/")) & F.endswith("key", F.lit(f"/{marker}"))).select(F.regexp_replace(rel, r"/[^/]*$", "").alias("folder")).distinct()


def namespace_snapshot(entries: DataFrame, prefix: str) -> DataFrame:
    """(rel_path, kind) of the live files and the kept empty folders below a prefix.  Two spellings of one
    case-folded path, or a path that is both file and folder, fail the snapshot."""
    files = scan_index(entries, prefix).where("state <> 'deleted'").select("rel_path", F.lit("file").alias("kind"))
    rows = files.unionByName(empty_dirs(entries, prefix).select(F.col("folder").alias("rel_path"), F.lit("empty_dir").alias("kind")))
    role = F.when((F.col("folder") == F.col("rel_path")) & (F.col("kind") == "file"), "file").otherwise("directory")
    claims = namespace.with_ancestors(rows, "rel_path").select("rel_path", F.col("folder").alias("claim"), role.alias("role"), paths.casefold(F.col("folder")).alias("folded"))
    bad = claims.join(namespace.claims_faults(claims).select("folded"), "folded").select("rel_path", F.lit(True).alias("_bad")).distinct()
    failed = F.raise_error(F.concat(F.lit("names clash at "), F.col("rel_path")))
    return rows.join(bad, "rel_path", "left").select(F.when(F.col("_bad"), failed).otherwise(F.col("rel_path")).alias("rel_path"), "kind")


def scan_keys(objects: DataFrame, prefix: str, kind: str) -> DataFrame:
    """Names of stored manifests or chunks (key[, last_modified]); unsafe names fail the scan."""
    name = F.substr("key", F.lit(len(prefix) + len(kind) + 3))
    rows = objects.where(F.startswith("key", F.lit(f"{prefix}/{kind}/")))
    return rows.select(F.when(paths.is_key_component(name), name).otherwise(F.raise_error(F.concat(F.lit("unsafe key: "), F.col("key")))).alias("name"), *[c for c in rows.columns if c != "key"])


def trash_keys(objects: DataFrame, prefix: str) -> DataFrame:
    """Trash objects (key): path, trashed_at and the issue of keys that cannot be read."""
    rest = F.substr("key", F.lit(len(prefix) + len("/trash/") + 1))
    stamp = F.regexp_extract(rest, r"^([0-9]+)-[^/]+/", 1)
    path = F.regexp_replace(rest, r"^[^/]+/", "")
    return objects.where(F.startswith("key", F.lit(f"{prefix}/trash/"))).select("key", F.when(stamp != "", path).alias("path"), F.when(stamp != "", stamp.cast("bigint")).alias("trashed_at"), F.when(stamp == "", "unreadable generation").alias("issue"))


#: Index rows that one bucket holds on average.
ROWS_A_BUCKET = 1_000_000


def write_index(entries: DataFrame, out: str, buckets: int | None = None) -> None:
    """The index as Parquet partitioned by a path hash, so that a lookup reads one bucket.
    Without ``buckets`` their number follows from the rows."""
    if buckets is None:
        buckets = max(1, -(-entries.count() // ROWS_A_BUCKET))
    entries.withColumn("bucket", F.pmod(F.xxhash64("rel_path"), F.lit(buckets))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)


def _versions(spark: SparkSession, out: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_versions")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _claim_version(spark: SparkSession, out: str, number: int, buckets: int) -> None:
    """Take a version's name; whoever comes second fails."""
    files, folder = _versions(spark, out)
    try:
        files.create(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}-of-{buckets}"), False).close()
    except Exception as taken:
        raise RuntimeError(f"stale base: version {number} of {out} is there already") from taken


def index_version(spark: SparkSession, out: str) -> tuple[int, int]:
    """(version, buckets) of an index that ``create_index`` made."""
    files, folder = _versions(spark, out)
    number, _, buckets = max(f.getPath().getName() for f in files.listStatus(folder)).partition("-of-")
    return int(number), int(buckets)


def create_buckets(rows: DataFrame, key: str, out: str, buckets: int | None = None) -> None:
    """Rows by buckets of a hash of their key, as version 0 of a table whose buckets can be replaced."""
    count = buckets if buckets is not None else max(1, -(-rows.count() // ROWS_A_BUCKET))
    in_bucket(rows, key, count).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
    _claim_version(rows.sparkSession, out, 0, count)


def in_bucket(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def current_base(spark: SparkSession, out: str, base: int) -> int:
    """The number of buckets of a table that is still at version ``base``; else an error."""
    now, buckets = index_version(spark, out)
    if now != base:
        raise RuntimeError(f"stale base: {out} is at version {now}, not {base}")
    return buckets


def replace_buckets(rows: DataFrame, out: str, base: int, buckets: int) -> int:
    """The buckets of rows (..., bucket) in place of those of version ``base``; the others keep their files.  Returns the new
    version.  Of two writers from one base one fails; one that is lost after its claim repeats its change from the new version."""
    _claim_version(rows.sparkSession, out, base + 1, buckets)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out)
    return base + 1


def beside(out: str) -> str:
    """A new folder for buckets that ``move_buckets`` will move into a table: on its file system, hidden from its readers."""
    return f"{out}/_staged-{uuid.uuid4().hex}"


def move_buckets(spark: SparkSession, staged: str, out: str, base: int, buckets: int) -> int:
    """``replace_buckets`` of buckets that were written to a folder ``beside`` the table: they are moved, not written again."""
    _claim_version(spark, out, base + 1, buckets)
    files, path = _versions(spark, out)[0], spark._jvm.org.apache.hadoop.fs.Path
    for made in files.listStatus(path(staged)):  # as many as the table has buckets, at most
        name = made.getPath().getName()
        if name.startswith("bucket="):
            files.delete(path(out, name), True)
            if not files.rename(made.getPath(), path(out, name)):
                raise RuntimeError(f"{name} of {staged} cannot be moved")
    files.delete(path(staged), True)
    return base + 1


def create_index(entries: DataFrame, out: str, buckets: int | None = None) -> None:
    """The index by path buckets, which takes upserts."""
    create_buckets(entries, "rel_path", out, buckets)


def upsert_index(out: str, changes: DataFrame, base: int) -> int:
    """Rows (rel_path, ..., seq) into an index at version ``base``; returns the new version.

    Only the buckets that hold a changed path are read and written (dynamic partition overwrite), the others keep
    their files.  The highest seq of a path wins, so a repeated upsert changes nothing; a ``deleted`` row stays as a tombstone.
    A base that is no longer the last version fails before anything is written."""
    spark = changes.sparkSession
    buckets = current_base(spark, out, base)
    dealt = kept(in_bucket(changes, "rel_path", buckets), "changes")
    touched = [r.bucket for r in dealt.select("bucket").distinct().collect()]  # as many as the index has folders, at most
    held = spark.read.parquet(out).where(F.col("bucket").isin(touched)).select(*dealt.columns)
    both = kept(lifecycle.apply_changes(held, dealt, "rel_path"), "upserted")
    return replace_buckets(both.repartition("bucket"), out, base, buckets)


def publish(staged: DataFrame, index: DataFrame) -> DataFrame:
    """Staged entries (rel_path, manifest_key, base_seq, seq) against the index (rel_path, seq, ...):
    committed where the index is still at base_seq (null: absent), else conflict.  Pure plan: the caller
    writes committed rows with ``write_index``."""
    now = index.select("rel_path", F.col("seq").alias("_seq"))
    joined = staged.join(now, "rel_path", "left")
    return joined.withColumn("outcome", F.when(F.col("_seq").eqNullSafe(F.col("base_seq")), "committed").otherwise("conflict")).drop("_seq")


def publish_fresh(staged: DataFrame, index: DataFrame) -> DataFrame:
    """Publishing below a fresh prefix: no baseline is read, and an entry that is there all the same is a conflict."""
    return publish(staged.withColumn("base_seq", F.lit(None).cast("bigint")), index)


def write_chunks(chunks: DataFrame, out: str) -> None:
    """Each distinct chunk once, partitioned by the first two digits of its hash."""
    once = chunks.groupBy("hash").agg(F.first("chunk").alias("chunk"), F.max("length").alias("length"))
    once.withColumn("shard", paths.shard(F.col("hash"))).repartition("shard").write.mode("append").partitionBy("shard").parquet(out)


def migrate_prefix(source: DataFrame, target: DataFrame, old: str, new: str) -> DataFrame:
    """Outcome of re-keying each source entry (key, content): would_copy, already_exact,
    destination_conflict; entries outside the old prefix are left out."""
    moved = source.where(F.startswith("key", F.lit(f"{old}/"))).withColumn("new_key", F.concat(F.lit(new), F.substr("key", F.lit(len(old) + 1))))
    t = target.select(F.col("key").alias("new_key"), F.col("content").alias("_there"))
    joined = moved.join(t, "new_key", "left")
    return joined.select("key", "new_key", F.when(F.col("_there").isNull(), "would_copy").when(F.col("_there") == F.col("content"), "already_exact").otherwise("destination_conflict").alias("outcome"))


def write_inventory(rows: DataFrame, out: str) -> None:
    """Inventory rows as JSON lines, and their summary."""
    rows.write.mode("overwrite").json(f"{out}/rows")
    rows.groupBy("decision", "reason").agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{out}/summary")
