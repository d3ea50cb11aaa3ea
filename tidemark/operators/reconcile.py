"""Three-way reconciliation (J01-J04, J07, A01, A05, T01, V11) as one lazy plan.

Inputs: ``local`` (rel_path, hash, clock[, kind]), ``remote`` index rows (rel_path, manifest_key, hash,
clock, state[, kind]) and ``tracked`` (rel_path, hash, status).  Alignment is a union and one aggregation
on rel_path, so three inputs meet in a single shuffle; presence is an explicit flag, never a null hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clocks, ingress, paths

#: Order of actions in a plan.
RANKS = {"conflict": 0, "create_dir": 1, "pull": 2, "push": 3, "delete_local": 4, "delete_remote": 5, "up_to_date": 6}


def identity(kind: Column, digest: Column, domain: str = "logical-content-v1") -> Column:
    """Content identity with its kind, so that a link never equals a file."""
    return F.concat_ws(":", F.lit(domain), kind, digest)


def align(local: DataFrame, remote: DataFrame, tracked: DataFrame) -> DataFrame:
    """One row per path of any side, with structs ``l``, ``r`` and ``t`` (null where absent)."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("rel_path", *[F.struct(*[F.col(c) for c in df.columns if c != "rel_path"]).alias(tag)])

    sides = [side(local, "l"), side(remote, "r"), side(tracked, "t")]
    rows = sides[0].unionByName(sides[1], allowMissingColumns=True).unionByName(sides[2], allowMissingColumns=True)
    return rows.groupBy("rel_path").agg(*[F.first(c, ignorenulls=True).alias(c) for c in "lrt"])


def classify(aligned: DataFrame, device: str, delete_local_orphans: bool = False, delete_remote_orphans: bool = False) -> DataFrame:
    """(rel_path, action, reason) by presence, then by content and clocks.

    A remote row whose state is ``deleted`` is absent, but alone authorises a local deletion."""
    here, known = F.col("l").isNotNull(), F.col("t").isNotNull()
    there = F.col("r").isNotNull() & (F.coalesce(F.col("r.state"), F.lit("committed")) != "deleted")
    tombstone = F.coalesce(F.col("r.state") == "deleted", F.lit(False))
    moved = paths.is_git_ref_class(F.col("rel_path")) & ~F.col("l.hash").eqNullSafe(F.col("t.hash"))
    local_clock = clocks.inferred_tick(F.col("l.clock"), F.col("r.clock"), F.lit(device), F.col("t.hash"), F.col("l.hash"))
    same = clocks.outcome(local_clock, F.col("r.clock"), F.col("l.hash"), F.col("r.hash"))
    verdict = (
        F.when(here & there, same)
        .when(here & ~known, "new_local")
        .when(there & known, "orphan_remote" if delete_remote_orphans else "up_to_date")
        .when(there, "new_remote")
        .when(here & moved, "local_newer")
        .when(here & tombstone, "deleted_remotely" if delete_local_orphans else "up_to_date")
        .otherwise("up_to_date")
    )
    actions = {"local_newer": "push", "new_local": "push", "remote_newer": "pull", "new_remote": "pull", "conflict": "conflict", "orphan_remote": "delete_remote", "deleted_remotely": "delete_local"}
    action = F.lit("up_to_date")
    for reason, name in actions.items():
        action = F.when(F.col("reason") == reason, name).otherwise(action)
    return aligned.withColumn("reason", verdict).withColumn("action", action)


def plan(local: DataFrame, remote: DataFrame, tracked: DataFrame, device: str, **flags) -> DataFrame:
    """The plan's rows: rel_path, action, reason."""
    return classify(align(local, remote, tracked), device, **flags).select("rel_path", "action", "reason")


def ranked(rows: DataFrame) -> DataFrame:
    """Action rank, then other paths before git refs, then rel_path (the last key makes it total)."""
    rank = F.lit(len(RANKS))
    for name, value in RANKS.items():
        rank = F.when(F.col("action") == name, value).otherwise(rank)
    return rows.withColumn("rank", rank).withColumn("git_rank", paths.is_git_ref_class(F.col("rel_path")).cast("int")).orderBy("rank", "git_rank", "rel_path")


def summary(rows: DataFrame) -> DataFrame:
    """Actions by kind."""
    return rows.groupBy("action").agg(F.count("*").alias("n"))


def unsafe_actions(rows: DataFrame) -> DataFrame:
    """Planned paths that fail validation before execution, with the fault."""
    fault = F.coalesce(paths.canonical_fault(F.col("rel_path")), ingress.fixed_ingress_reason(F.col("rel_path")))
    return rows.where("action <> 'up_to_date'").withColumn("fault", fault).where("fault IS NOT NULL")


def reclassify_fast_forwards(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Conflicts inside a repository become pushes or pulls if every conflicting branch head is a
    fast-forward in one direction, and no other ref-class path conflicts.

    heads: (rel_path, direction) with local_ahead / remote_ahead / neither, for branch heads."""
    repo = F.when(F.col("action") == "conflict", paths.repo_root(F.col("rel_path")))
    marked = rows.withColumn("repo", repo).join(heads, "rel_path", "left")
    is_head = paths.head_ref(F.col("rel_path")).isNotNull()
    veto = paths.is_git_ref_class(F.col("rel_path")) & ~is_head
    direction = F.when(is_head, F.coalesce("direction", F.lit("neither")))
    by_repo = marked.where("repo IS NOT NULL").groupBy("repo").agg(F.bool_or(veto).alias("veto"), F.min(direction).alias("low"), F.max(direction).alias("high"))
    decided = by_repo.where("NOT veto AND low = high AND low <> 'neither'").select("repo", F.when(F.col("low") == "local_ahead", "push").otherwise("pull").alias("decision"))
    return marked.join(decided, "repo", "left").select("rel_path", F.coalesce("decision", "action").alias("action"), F.when(F.col("decision").isNotNull(), "git_fast_forward").otherwise(F.col("reason")).alias("reason"))


def two_way_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(path, status) of two listings (path, hash): local_only, remote_only, unchanged, modified."""
    both = local.select("path", F.col("hash").alias("l")).join(remote.select("path", F.col("hash").alias("r")), "path", "full_outer")
    status = F.when(F.col("r").isNull(), "local_only").when(F.col("l").isNull(), "remote_only").when(F.col("l") == F.col("r"), "unchanged").otherwise("modified")
    return both.select("path", status.alias("status"))


def needs_sync(files: DataFrame, state: DataFrame) -> DataFrame:
    """(path, reason) of files (path, size, mtime, hash) against state (path, size, mtime, hash)."""
    s = state.select("path", F.struct("size", "mtime", "hash").alias("s"))
    joined = files.join(s, "path", "left")
    reason = F.when(F.col("s").isNull(), "new file").when(F.col("size") != F.col("s.size"), "size changed").when((F.col("mtime") != F.col("s.mtime")) & (F.col("hash") != F.col("s.hash")), "content changed")
    return joined.select("path", reason.alias("reason"))
