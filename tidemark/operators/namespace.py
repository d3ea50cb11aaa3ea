"""Policies, listings and namespace checks: J08-J11, J13-J15, F08-F10, F16, V02-V04, V07, V08, S10, S11, M01, M02."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ingress, paths
from tidemark.operators import folders
from tidemark.operators.checkpoints import kept

#: Policies up to which they are broadcast; beyond that the ancestor join shuffles.
BROADCAST_POLICIES = 100_000


def with_ancestors(rows: DataFrame, path: str = "path") -> DataFrame:
    """Each row once for itself and once for each ancestor folder (``folder``, ``depth``)."""
    chain = F.concat(paths.ancestors(F.col(path)), F.array(F.col(path)))
    return rows.select("*", F.posexplode(chain).alias("depth", "folder"))


def nearest_policy(files: DataFrame, policies: DataFrame, path: str = "path", broadcast_rows: int | None = None) -> DataFrame:
    """Files with the policy (folder, sync_mode, download_threshold) of the path or its nearest ancestor.

    Few policies, by their counted rows (``broadcast_rows``), are broadcast to the ancestors of each path, and the deepest
    match wins.  More of them are laid between the paths in the order of the tree (``folders.nearest_above``)."""
    small = broadcast_rows if broadcast_rows is not None else policies.count()
    if small <= BROADCAST_POLICIES:
        side = policies.select("folder", F.struct("sync_mode", "download_threshold", F.col("folder").alias("policy_folder")).alias("policy"))
        best = with_ancestors(files.select(path), path).join(F.broadcast(side), "folder").groupBy(path).agg(F.max_by("policy", "depth").alias("policy"))
    else:
        marks = policies.select("folder", "sync_mode", "download_threshold", F.col("folder").alias("policy_folder"))
        mark = F.struct("mark.sync_mode", "mark.download_threshold", "mark.policy_folder").alias("policy")
        best = folders.nearest_above(files, marks, path).select(path, mark)
    return files.join(best, path, "left").select(*files.columns, "policy.*")


def auto_download(sync_mode: Column, size: Column, folder_threshold: Column, global_threshold: Column) -> Column:
    """F16: always, never, or on demand up to the folder's (else the global) size."""
    mode = F.coalesce(sync_mode, F.lit("on_demand"))
    return F.when(mode == "always", True).when(mode == "never", False).otherwise(size <= F.coalesce(folder_threshold, global_threshold))


def within_roots(path: Column, roots: list[str]) -> Column:
    """equal to or below a root; no root or an empty one matches all."""
    if not roots or "" in roots:
        return F.lit(True)
    hit = F.lit(False)
    for r in roots:
        hit = hit | (path == r) | F.startswith(path, F.lit(f"{r}/"))
    return hit


def remainder(path: Column, prefix: str) -> Column:
    """what follows ``prefix/``; null elsewhere or if nothing follows.  An empty prefix keeps all."""
    rest = path if prefix == "" else F.when(F.startswith(path, F.lit(f"{prefix}/")), F.substr(path, F.lit(len(prefix) + 2)))
    return F.when(rest != "", rest)


def key_within(key: Column, prefix: str) -> Column:
    """component-bounded containment of a storage key."""
    clean = prefix.rstrip("/")
    return F.startswith(key, F.lit(f"{clean}/")) if clean else F.lit(True)


def children_of(state: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """Rows below a folder (``a`` never matches ``ab``)."""
    return state.where(F.startswith(path, F.lit(f"{folder}/")))


def lookup(state: DataFrame, wanted: DataFrame, path: str = "path") -> DataFrame:
    """S11 by exact keys: the suffix match of the original is ambiguous by its own admission."""
    return wanted.join(state, path, "left")


def rollup(files: DataFrame, prefix: str = "", path: str = "path") -> DataFrame:
    """Distinct first components below a prefix: (entry, is_dir); folders end with a slash."""
    rest = remainder(F.col(path), prefix)
    first = F.substring_index("rest", "/", 1)
    found = files.select(rest.alias("rest")).where("rest IS NOT NULL")
    return found.select(F.when(F.contains("rest", F.lit("/")), F.concat(first, F.lit("/"))).otherwise(first).alias("entry"), F.contains("rest", F.lit("/")).alias("is_dir")).distinct().orderBy("entry")


def roots(files: DataFrame, path: str = "path") -> DataFrame:
    """The distinct first components, in byte order."""
    return files.select(F.substring_index(path, "/", 1).alias("root")).distinct().orderBy("root")


def read_dir(index: DataFrame, prefix: str = "", path: str = "path") -> DataFrame:
    """(name, is_dir) of immediate children; a folder hides a file of its name, deleted files go."""
    live = index.where("state <> 'deleted'")
    listed = rollup(live, prefix, path).select(F.regexp_replace("entry", "/$", "").alias("name"), "is_dir")
    return listed.groupBy("name").agg(F.max("is_dir").alias("is_dir"))


def enrich(remote: DataFrame, state: DataFrame) -> DataFrame:
    """Remote rows (rel_path, manifest_key) with state columns only where the manifests agree."""
    s = state.select("rel_path", F.col("manifest_key").alias("_held"), "status", "last_synced")
    return remote.join(s, (remote.rel_path == s.rel_path) & (remote.manifest_key == s["_held"]), "left").select(remote["*"], F.coalesce("status", F.lit("not_synced")).alias("status"), "last_synced")


def discover(remote: DataFrame, state: DataFrame) -> DataFrame:
    """Remote paths without state, as new not_synced rows."""
    return remote.join(state.select("rel_path"), "rel_path", "left_anti").withColumn("status", F.lit("not_synced"))


def by_basename(names: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """(name, path, outcome): one match is ok, more are ambiguous, none is missing."""
    per = files.groupBy(paths.name(F.col(path)).alias("name")).agg(F.count("*").alias("n"), F.min(path).alias("one"))
    joined = names.join(per, "name", "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select("name", F.when(n == 1, F.col("one")).alias("path"), F.when(n == 1, "ok").when(n > 1, "ambiguous").otherwise("missing").alias("outcome"))


def ancestor_collisions(files: DataFrame, path: str = "path") -> DataFrame:
    """Files that are also a folder of another file."""
    hit = folders.with_below(files.select(path).distinct(), F.lit(True), path).where("has_below").select(path)
    return files.select(path).join(hit, path, "left_semi")


def namespace_faults(files: DataFrame, folded: Column, path: str = "path") -> DataFrame:
    """(folded, spellings, roles) of claims that clash: one claim for the leaf and one for
    each folder; a folded path must have one spelling and one role."""
    leaf = files.select(F.col(path).alias("claim"), F.lit("file").alias("role"), folded.alias("folded"))
    return claims_faults(leaf.unionByName(folders.folder_claims(files, folded, path)))


def claims_faults(claims: DataFrame) -> DataFrame:
    per = claims.groupBy("folded").agg(F.count_distinct("claim").alias("spellings"), F.count_distinct("role").alias("roles"))
    return per.where("spellings > 1 OR roles > 1")


#: Buckets of held claims: a batch reads only those that its own claims fall into.
CLAIM_BUCKETS = 64


def claims_of(files: DataFrame, path: str = "path") -> DataFrame:
    """V07 for each path by itself: (path, claim, role, folded, bucket) of the leaf and of every folder above it."""
    rows = with_ancestors(files.select(path, paths.casefold(F.col(path)).alias("_folded")), path)
    role = F.when(F.col("folder") == F.col(path), "file").otherwise("directory")
    folded = F.array_join(F.slice(paths.components(F.col("_folded")), F.lit(1), F.col("depth") + 1), "/")
    return rows.select(path, F.col("folder").alias("claim"), role.alias("role"), folded.alias("folded"), F.pmod(F.xxhash64(folded), F.lit(CLAIM_BUCKETS)).alias("bucket"))


def write_claims(files: DataFrame, out: str, path: str = "path") -> None:
    """The claims of a namespace as a table by buckets of the folded path, each claim once."""
    claims_of(files, path).select("claim", "role", "folded", "bucket").distinct().repartition("bucket").write.mode("append").partitionBy("bucket").parquet(out)


def admit(held: DataFrame, incoming: DataFrame, path: str = "path") -> DataFrame:
    """Incoming (path, seq) with ``outcome``: admitted, spelling_collision or role_collision, in order of seq.

    held: claims as ``write_claims`` stores them.  A path is admitted if each of its claims agrees, in spelling and in role, with what
    is held and with what earlier admitted paths claim; a refused path claims nothing.  Each round admits all paths that no
    earlier open path contradicts and refuses those that what is admitted contradicts, so rounds follow the longest chain
    of contradictions.  Only buckets of the batch's own claims are read.  Sequence numbers are distinct; a path that comes
    again agrees with itself; null paths are left out."""
    wanted = incoming.where(F.col(path).isNotNull() & F.col("seq").isNotNull())
    claims = kept(claims_of(wanted, path).distinct().join(wanted.select(path, "seq"), path), "claims")
    buckets = [r.bucket for r in claims.select("bucket").distinct().collect()]  # CLAIM_BUCKETS at most
    keys = claims.select("folded").distinct()
    known = held.where(F.col("bucket").isin(buckets)).join(keys, "folded", "left_semi").select("folded", F.col("claim").alias("_claim"), F.col("role").alias("_role"))
    open_, done = claims.select(path, "seq", "claim", "role", "folded"), None
    spelling, role = F.col("claim") != F.col("_claim"), F.col("role") != F.col("_role")
    while True:
        against = open_.join(known.distinct(), "folded").where(spelling | role)
        refused = against.groupBy(path, "seq").agg(F.when(F.bool_or(spelling), "spelling_collision").otherwise("role_collision").alias("outcome"))
        refused = kept(refused, "refused")
        still = open_.join(refused.select(path, "seq"), [path, "seq"], "left_anti")
        first = still.groupBy("folded", "claim", "role").agg(F.min("seq").alias("since"))
        other = first.select("folded", F.col("claim").alias("_claim"), F.col("role").alias("_role"), F.col("since").alias("_since"))
        blocked = still.join(other, "folded").where((spelling | role) & (F.col("_since") < F.col("seq"))).select(path, "seq").distinct()
        admitted = kept(still.join(blocked, [path, "seq"], "left_anti"), "admitted")
        said = refused.unionByName(admitted.select(path, "seq").distinct().withColumn("outcome", F.lit("admitted")))
        done = said if done is None else done.unionByName(said)
        open_ = kept(still.join(admitted.select(path, "seq").distinct(), [path, "seq"], "left_anti"), "open")
        if open_.isEmpty():
            return wanted.join(done, [path, "seq"])
        known = admitted.select("folded", F.col("claim").alias("_claim"), F.col("role").alias("_role"))


def denied_remote(remote: DataFrame, **rules) -> DataFrame:
    """Remote paths that the deny rules hold back, with the reason."""
    return remote.select("rel_path", ingress.component_reason(F.col("rel_path"), **rules).alias("reason")).where("reason IS NOT NULL")


def rebind_events(events: DataFrame, index: DataFrame) -> DataFrame:
    """Events (rel_path) against the current index (rel_path, state, manifest_key): deleted, live or
    missing.  Works on a stream of events with a static index too."""
    i = index.select("rel_path", "state", "manifest_key")
    now = F.when(F.col("state").isNull(), "missing").when(F.col("state") == "deleted", "deleted").otherwise("live")
    return events.join(i, "rel_path", "left").withColumn("now", now).drop("state")


def get_attributes(wanted: DataFrame, index: DataFrame, path: str = "path") -> DataFrame:
    """(path, kind): file for a live row, directory for an ancestor of one, else not_found."""
    live = index.where("state <> 'deleted'").select(path, F.lit(True).alias("live"))
    both = live.unionByName(wanted.select(path, F.lit(False).alias("live"))).groupBy(path).agg(F.bool_or("live").alias("live"))
    kinds = folders.with_below(both, F.col("live"), path)
    joined = wanted.select(path).join(kinds, path, "left")
    return joined.select(path, F.when(F.col(path) == "", "directory").when(F.col("live"), "file").when(F.col("has_below"), "directory").otherwise("not_found").alias("kind"))


def read_slice(content: Column, offset: Column, size: Column) -> Column:
    """Bytes [offset, offset + size) of a content, as bytes."""
    return F.substr(content.cast("binary"), offset + 1, size)
