"""Ingress rules, paths, policies, listings and registries over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ingress, paths
from tidemark.operators import devices, namespace, reconcile
from tidemark.operators.checkpoints import work_folder
from tidemark.plans.catalog import query
from tidemark.plans.core import SIDES, _plan_sql, plan
from tidemark.plans.fixtures import POLICIES, load, policies
from tidemark.sources import tables
from tidemark.sources.tables import read_table

GLOBS = ["*.tmp", "img?"]

#: One name's reason (name n, directory flag d), with the rules in their order.
_SECURITY = """CASE WHEN lower(n) IN ('.ssh', '.gnupg', 'sops-nix') THEN concat('security: ', lower(n)) WHEN lower(n) IN ('.credentials.json', 'auth.json', '.netrc', '.pgpass', 'master.key') THEN concat('security: ', lower(n))
 WHEN lower(n) LIKE '%.rotate-pending' THEN 'security: rotation-pending-key' WHEN lower(n) LIKE '%.rotate-state.json' THEN 'security: rotation-state'
 WHEN regexp_matches(lower(n), '^\\..*\\.tmp\\.[0-9a-f]{32}$') THEN 'security: atomic-write-temp' WHEN lower(n) = '.env' OR lower(n) LIKE '.env.%' OR lower(n) LIKE '%.env' THEN 'security: dotenv'
 WHEN regexp_matches(lower(n), '\\.(sqlite|sqlite3|sqlite-wal|sqlite-shm|db|db-wal|db-shm)$') THEN 'security: live-db' END"""
_NAME = f"""coalesce({_SECURITY}, CASE WHEN d AND lower(n) IN ('target', 'node_modules') THEN concat('built-in: ', lower(n)) WHEN lower(n) = '.ds_store' THEN 'built-in: .DS_Store' WHEN lower(n) = '.dir_marker' THEN 'directory marker'
 WHEN regexp_matches(n, '^.+\\.(tc|tcf)$') THEN 'stub extension' WHEN n LIKE '%.tmp' THEN 'glob: *.tmp' WHEN regexp_matches(n, '^img.$') THEN 'glob: img?' WHEN lower(n) = '.git' AND NOT d THEN 'gitfile pointer' WHEN lower(n) = '.git' THEN '.git directory'
 WHEN d AND n LIKE '.%' THEN 'hidden directory' END)"""
_FENCE = """CASE WHEN concat('/', lower(path), '/') LIKE '%/.git/worktrees/%' THEN '.git/worktrees admin area' WHEN regexp_matches(concat('/', lower(path), '/'), '/\\.git/.*\\.lock/$') THEN 'git lockfile' END"""
_BY_NAME = f"rows_of AS (SELECT doc_id, path, {_FENCE} AS fence, string_split(path, '/')[-1] AS n, false AS d FROM inventory)"
_BY_PART = "parts AS (SELECT doc_id, path, string_split(path, '/')[i] AS n, true AS d, i FROM inventory, unnest(range(1, len(string_split(path, '/')) + 1)) AS u(i))"


@query(f"WITH {_BY_NAME} SELECT reason, count(*) AS n FROM (SELECT coalesce(fence, {_NAME}) AS reason FROM rows_of) GROUP BY reason", "inventory")
def deny_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "inventory").groupBy(ingress.path_reason(F.col("path"), F.lit(False), globs=GLOBS).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_BY_PART}, hits AS (SELECT doc_id, min(i) AS i FROM (SELECT *, {_NAME} AS reason FROM parts) WHERE reason IS NOT NULL GROUP BY doc_id) SELECT v.doc_id, coalesce({_FENCE}, (SELECT {_NAME} FROM parts p WHERE p.doc_id = h.doc_id AND p.i = h.i)) AS reason FROM inventory v LEFT JOIN hits h ON h.doc_id = v.doc_id", "inventory")
def deny_components(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "inventory").select("doc_id", ingress.component_reason(F.col("path"), globs=GLOBS).alias("reason"))


_SECURITY_HITS = f"{_BY_PART}, hits AS (SELECT doc_id, arg_min(reason, i) AS reason FROM (SELECT *, {_SECURITY} AS reason FROM parts) WHERE reason IS NOT NULL GROUP BY doc_id)"


@query(f"WITH {_SECURITY_HITS} SELECT v.doc_id, coalesce(CASE WHEN concat('/', lower(path), '/') LIKE '%/.git/worktrees/%' THEN '.git/worktrees admin area' END, h.reason) AS security, coalesce({_FENCE}, h.reason) AS fixed FROM inventory v LEFT JOIN hits h ON h.doc_id = v.doc_id", "inventory")
def deny_fixed(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "inventory").select("doc_id", ingress.security_reason(F.col("path")).alias("security"), ingress.fixed_ingress_reason(F.col("path")).alias("fixed"))


@query(f"WITH {_BY_PART}, hits AS (SELECT doc_id, arg_min(reason, i) AS reason FROM (SELECT *, {_NAME} AS reason FROM parts) WHERE reason IS NOT NULL GROUP BY doc_id) SELECT v.path AS rel_path, coalesce({_FENCE}, h.reason) AS reason FROM inventory v LEFT JOIN hits h ON h.doc_id = v.doc_id WHERE coalesce({_FENCE}, h.reason) IS NOT NULL", "inventory")
def denied_remote(spark: SparkSession, d: str) -> DataFrame:
    return namespace.denied_remote(load(spark, d, "inventory").withColumnRenamed("path", "rel_path"), globs=GLOBS)


#: Paths of which each shape has one fault, and the fault's name.
_SHAPES = "CASE doc_id % 10 WHEN 0 THEN concat('/', rel_path) WHEN 1 THEN concat('../', rel_path) WHEN 2 THEN concat(rel_path, '.') WHEN 3 THEN concat(rel_path, '?') WHEN 4 THEN concat(rel_path, '/nul.txt') WHEN 5 THEN concat(rel_path, '/.GIT/x') WHEN 6 THEN concat(rel_path, '/.git/Head') WHEN 7 THEN concat(rel_path, '/.ssh/id') WHEN 8 THEN concat(rel_path, 'e', {mark}) ELSE rel_path END"
_SHAPE_FAULTS = "CASE doc_id % 10 WHEN 0 THEN 'not_relative' WHEN 1 THEN 'dot_component' WHEN 2 THEN 'trailing_dot_or_space' WHEN 3 THEN 'forbidden_character' WHEN 4 THEN 'device_name' WHEN 5 THEN 'git_alias' WHEN 6 THEN 'git_metadata_alias' WHEN 8 THEN 'not_nfc' END"


def _shaped(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "tree").select("doc_id", F.expr(_SHAPES.format(mark="decode(X'CC81', 'UTF-8')")).alias("rel_path"))


@query(f"SELECT rel_path, action, fault FROM (SELECT doc_id, {_SHAPES.format(mark='chr(769)')} AS rel_path, CASE doc_id % 3 WHEN 0 THEN 'push' WHEN 1 THEN 'pull' ELSE 'up_to_date' END AS action, CASE WHEN doc_id % 10 = 7 THEN 'security: .ssh' ELSE {_SHAPE_FAULTS} END AS fault FROM tree) WHERE action <> 'up_to_date' AND fault IS NOT NULL", "tree")
def unsafe_actions(spark: SparkSession, d: str) -> DataFrame:
    """Actions over paths of all shapes; those that change nothing are not looked at."""
    action = F.when(F.col("doc_id") % 3 == 0, "push").when(F.col("doc_id") % 3 == 1, "pull").otherwise("up_to_date")
    return reconcile.unsafe_actions(_shaped(spark, d).withColumn("action", action)).select("rel_path", "action", "fault")


@query(_plan_sql(False, False) + " SELECT count(*) AS planned, 0::BIGINT AS unsafe FROM p WHERE action <> 'up_to_date'", SIDES)
def plan_is_safe(spark: SparkSession, d: str) -> DataFrame:
    """V11 over the plan itself, whose paths are clean."""
    rows = plan(spark, d)
    unsafe = reconcile.unsafe_actions(rows).select("rel_path", F.lit(1).alias("one"))
    return rows.where("action <> 'up_to_date'").join(unsafe, "rel_path", "left").agg(F.count("*").alias("planned"), F.count("one").alias("unsafe"))


#: The inventory's rules as a table of runs of components and a name's tests, in their order.
_DECISION = """WITH runs AS (SELECT string_split(r, '/') AS run, kind FROM (VALUES ('.cache', 1), ('.direnv', 1), ('.git', 1), ('.gnupg', 1), ('.ssh', 1), ('.tmp', 1), ('.venv', 1), ('.claude/worktrees', 1), ('.claude/backups', 1), ('.codex/cache', 1), ('.codex/log', 1), ('.codex/plugins/cache', 1), ('.codex/tmp', 1), ('.crush/logs', 1), ('.claude/plugins/cache', 1), ('cache', 1), ('backups', 1), ('log', 1), ('logs', 1), ('node_modules', 1), ('nix/secrets', 1), ('plugins/cache', 1), ('sops-nix', 1), ('target', 1), ('tmp', 1), ('worktrees', 1), ('.artifacts', 2), ('.svelte-kit', 2), ('build', 2), ('dist', 2), ('result', 2)) v(r, kind)),
places AS (SELECT doc_id, string_split(path, '/') AS c, i FROM mirror_rows, unnest(range(1, len(string_split(path, '/')) + 1)) AS u(i)),
hits AS (SELECT doc_id, min(kind) AS kind FROM places, runs WHERE c[i] = run[1] AND c[i:(i + len(run) - 1)] = run GROUP BY doc_id),
named AS (SELECT m.doc_id, string_split(path, '/')[-1] AS n, is_symlink, kind FROM mirror_rows m LEFT JOIN hits h ON h.doc_id = m.doc_id),
ruled AS (SELECT doc_id, CASE WHEN kind = 1 THEN 'deny/secret-or-runtime-dir' WHEN kind = 2 THEN 'deny/generated-output' WHEN n IN ('.credentials.json', '.netrc', '.pgpass', 'auth.json', 'mcp-auth.json', 'mcp-needs-auth-cache.json', 'session-env') OR regexp_matches(n, '^[.]env(rc)?$|[.]env$|[.]env[.]') THEN 'deny/credential-or-env'
 WHEN regexp_matches(n, '-(wal|shm)$') THEN 'deny/live-db-sidecar' WHEN regexp_matches(n, '[.](sqlite3?|db)$') THEN '{databases}' WHEN regexp_matches(n, '[.]log$') THEN 'deny/runtime-log' WHEN is_symlink THEN 'deny/symlink-deferred' WHEN regexp_matches(n, '[.]jsonl$') THEN 'allow/append-log-active-writer-check-required' ELSE 'allow/default-allow' END AS x FROM named)
SELECT doc_id, split_part(x, '/', 1) AS decision, split_part(x, '/', 2) AS reason FROM ruled"""


@query(_DECISION.replace("{databases}", "snapshot/sqlite-backup-required"), "mirror_rows")
def inventory_decisions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "mirror_rows").select("doc_id", ingress.inventory_decision(F.col("path"), F.col("is_symlink")).alias("x")).select("doc_id", "x.*")


@query(_DECISION.replace("{databases}", "deny/sqlite-excluded-static-profile"), "mirror_rows")
def inventory_decisions_static(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "mirror_rows").select("doc_id", ingress.inventory_decision(F.col("path"), F.col("is_symlink"), snapshot_databases=False).alias("x")).select("doc_id", "x.*")


@query("SELECT doc_id, array_to_string(string_split(rel_path, '/')[1:i], '/') AS ancestor FROM tree, unnest(range(1, len(string_split(rel_path, '/')))) AS u(i)", "tree")
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "tree").select("doc_id", F.explode(paths.ancestors(F.col("rel_path"))).alias("ancestor"))


_NEAREST = f"WITH {POLICIES}, near AS (SELECT t.rel_path AS path, t.size, coalesce(b.sync_mode, a.sync_mode) AS sync_mode, CASE WHEN b.folder IS NOT NULL THEN b.download_threshold ELSE a.download_threshold END AS download_threshold, coalesce(b.folder, a.folder) AS policy_folder FROM tree t LEFT JOIN policies a ON a.folder = t.source LEFT JOIN policies b ON b.folder = concat(t.source, '/', t.lang))"


@query(_NEAREST + " SELECT path, sync_mode, download_threshold, policy_folder FROM near", "tree policy_rows policy_overrides")
def nearest_policy(spark: SparkSession, d: str) -> DataFrame:
    return namespace.nearest_policy(load(spark, d, "tree").select(F.col("rel_path").alias("path")), policies(spark, d))


@query(_NEAREST + " SELECT path, CASE sync_mode WHEN 'always' THEN true WHEN 'never' THEN false ELSE size <= coalesce(download_threshold, 1000) END AS download FROM near", "tree policy_rows policy_overrides")
def auto_download(spark: SparkSession, d: str) -> DataFrame:
    found = namespace.nearest_policy(load(spark, d, "tree").select(F.col("rel_path").alias("path"), "size"), policies(spark, d))
    return found.select("path", namespace.auto_download(F.col("sync_mode"), F.col("size"), F.col("download_threshold"), F.lit(1000)).alias("download"))


@query("""WITH cased AS (SELECT CASE WHEN doc_id % 9 = 0 THEN upper(path) ELSE path END AS path FROM inventory), claims AS (SELECT path AS claim, 'file' AS role FROM cased UNION SELECT array_to_string(string_split(path, '/')[1:i], '/'), 'directory' FROM cased, unnest(range(1, len(string_split(path, '/')))) AS u(i))
SELECT lower(claim) AS folded, count(DISTINCT claim) AS spellings, count(DISTINCT role) AS roles FROM claims GROUP BY lower(claim) HAVING count(DISTINCT claim) > 1 OR count(DISTINCT role) > 1""", "inventory")
def namespace_collisions(spark: SparkSession, d: str) -> DataFrame:
    cased = F.when(F.col("doc_id") % 9 == 0, F.upper("path")).otherwise(F.col("path"))
    return namespace.namespace_faults(load(spark, d, "inventory").withColumn("path", cased), F.lower("path"))


@query("""WITH asked AS (SELECT doc_id AS seq, doc_id // 10 AS g, doc_id % 5 AS kind, CASE doc_id % 5 WHEN 0 THEN concat('BASE/', doc_id::VARCHAR) WHEN 1 THEN 'base' WHEN 2 THEN concat('new/N', (doc_id // 10)::VARCHAR) WHEN 3 THEN concat('new/n', (doc_id // 10)::VARCHAR, '/', doc_id::VARCHAR) ELSE concat('fresh/', doc_id::VARCHAR) END AS path FROM tree WHERE doc_id % 3 <> 0),
firsts AS (SELECT g, arg_min(kind, seq) AS kind FROM asked WHERE kind IN (2, 3) GROUP BY g)
SELECT seq, path, CASE WHEN a.kind = 0 THEN 'spelling_collision' WHEN a.kind = 1 THEN 'role_collision' WHEN a.kind IN (2, 3) AND a.kind <> f.kind THEN 'spelling_collision' ELSE 'admitted' END AS outcome FROM asked a LEFT JOIN firsts f ON f.g = a.g""", "tree")
def admitted_names(spark: SparkSession, d: str) -> DataFrame:
    """A batch of new names against held claims and against each other."""
    t, k = load(spark, d, "tree"), F.col("doc_id")
    text = lambda c: c.cast("string")
    out = work_folder(spark, "claims")
    namespace.write_claims(t.where("doc_id % 3 = 0").select(F.concat(F.lit("base/"), text(k)).alias("path")), out)
    group = text(F.floor(k / 10))
    path = F.when(k % 5 == 0, F.concat(F.lit("BASE/"), text(k))).when(k % 5 == 1, "base").when(k % 5 == 2, F.concat(F.lit("new/N"), group)).when(k % 5 == 3, F.concat(F.lit("new/n"), group, F.lit("/"), text(k))).otherwise(F.concat(F.lit("fresh/"), text(k)))
    asked = t.where("doc_id % 3 <> 0").select(k.alias("seq"), path.alias("path"))
    return namespace.admit(spark.read.parquet(out), asked).select("seq", "path", "outcome")


@query("""WITH both_ AS (SELECT rel_path AS path FROM tree UNION ALL SELECT source FROM tree WHERE doc_id % 10 = 3), up AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') AS path FROM both_, unnest(range(1, len(string_split(path, '/')))) AS u(i))
SELECT path, count(*) AS n FROM both_ WHERE path IN (SELECT path FROM up) GROUP BY path""", "tree")
def ancestor_collisions(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "tree")
    both = t.select(F.col("rel_path").alias("path")).unionByName(t.where("doc_id % 10 = 3").select(F.col("source").alias("path")))
    return namespace.ancestor_collisions(both).groupBy("path").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT concat(split_part(path, '/', 1), '/') AS entry, true AS is_dir FROM inventory", "inventory")
def dir_listing(spark: SparkSession, d: str) -> DataFrame:
    return namespace.rollup(load(spark, d, "inventory"))


@query("""WITH below AS (SELECT substring(path, 6) AS rest FROM inventory WHERE path LIKE 'src1/%' AND doc_id % 4 <> 0)
SELECT split_part(rest, '/', 1) AS name, bool_or(rest LIKE '%/%') AS is_dir FROM below WHERE rest <> '' GROUP BY 1""", "inventory")
def readdir_children(spark: SparkSession, d: str) -> DataFrame:
    index = load(spark, d, "inventory").withColumn("state", F.when(F.col("doc_id") % 4 == 0, "deleted").otherwise("committed"))
    return namespace.read_dir(index, "src1")


@query("""WITH names AS (SELECT DISTINCT string_split(path, '/')[-1] AS name FROM inventory UNION SELECT 'absent.txt'), per AS (SELECT string_split(path, '/')[-1] AS name, count(*) AS n, min(path) AS one FROM inventory GROUP BY 1)
SELECT names.name, CASE WHEN n = 1 THEN one END AS path, CASE WHEN n = 1 THEN 'ok' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS outcome FROM names LEFT JOIN per ON per.name = names.name""", "inventory")
def basename_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    files = load(spark, d, "inventory")
    names = files.select(paths.name(F.col("path")).alias("name")).distinct().unionByName(spark.range(1).select(F.lit("absent.txt").alias("name")))
    return namespace.by_basename(names, files)


@query("""SELECT doc_id, CASE WHEN path LIKE '%/.git/%' THEN regexp_extract(path, '^(.*?)/\\.git/', 1) END AS repo_root, CASE WHEN path LIKE '%/.git/refs/heads/%' THEN concat('refs/heads/', regexp_extract(path, '\\.git/refs/heads/(.+)$', 1)) END AS head_ref,
 regexp_matches(path, '/\\.git/(refs/.*|packed-refs|HEAD)$') AS ref_class, regexp_matches(path, '/\\.git/objects/([0-9a-f]{2}/[0-9a-f]{38}|pack/pack-[0-9a-f]{40}\\.(pack|idx|rev))$') AS object_class FROM inventory""", "inventory")
def git_classes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return load(spark, d, "inventory").select("doc_id", paths.repo_root(p).alias("repo_root"), paths.head_ref(p).alias("head_ref"), paths.is_git_ref_class(p).alias("ref_class"), paths.is_git_object_class(p).alias("object_class"))


@query("SELECT doc_id, doc_id % 8 < 6 AS ref_class FROM tree", "tree")
def git_module_classes(spark: SparkSession, d: str) -> DataFrame:
    """P05 below .git/modules: refs of a submodule, of one without a name, and what only looks like them."""
    tails = ["m/refs/heads/x", "m/HEAD", "HEAD", "refs/x", "packed-refs", "a/b/packed-refs", "m/objects/aa", "m/headless"]
    tail = F.element_at(F.array(*map(F.lit, tails)), (F.col("doc_id") % 8 + 1).cast("int"))
    return load(spark, d, "tree").select("doc_id", paths.is_git_ref_class(F.concat(F.lit("r/.git/modules/"), tail)).alias("ref_class"))


@query("""SELECT doc_id, rel_path AS below, concat('x/', rel_path) AS elsewhere, CASE WHEN doc_id % 3 = 0 THEN substr(hash, 1, 40) WHEN doc_id % 3 = 1 THEN hash END AS sha, rel_path AS real, doc_id % 2 = 0 AS stub, doc_id % 5 = 0 AS routing, CASE WHEN doc_id % 4 <> 0 THEN hash END AS oid, concat('m', doc_id::VARCHAR) AS "cache",
 concat('version 2', chr(10), 'oid sha256:', hash, chr(10), 'size ', size::VARCHAR, chr(10)) AS stub_text FROM tree""", "tree")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """Roots cut off, ref files, placeholders and their names, object routing, digests, cache keys."""
    k, p, h = F.col("doc_id"), F.col("rel_path"), F.col("hash")
    ref = F.when(k % 3 == 0, F.concat(F.substr(h, F.lit(1), F.lit(40)), F.lit("\n"))).when(k % 3 == 1, F.concat(h, F.lit(" x"))).otherwise("ref: refs/heads/x")
    name = F.when(k % 2 == 0, F.concat(p, F.lit(".tcf"))).otherwise(p)
    kept = F.concat(F.lit("size 1\nbad\nversion 2\nsize "), F.col("size").cast("string"), F.lit("\noid sha256:"), h, F.lit("\n"))
    routing = F.concat(p, F.when(k % 5 == 0, "/.git/objects/info/alternates").otherwise("/.git/objects/info/packs"))
    return load(spark, d, "tree").select(
        "doc_id", paths.relative(F.concat(F.lit("root/"), p), F.lit("root")).alias("below"), paths.relative(F.concat(F.lit("/x/"), p), F.lit("root")).alias("elsewhere"), paths.ref_sha(ref).alias("sha"), paths.real_name(name).alias("real"), paths.is_stub(name).alias("stub"),
        paths.is_git_object_routing(routing).alias("routing"), paths.oid_hex(F.when(k % 4 == 0, h).otherwise(F.concat(F.lit("sha256:"), h))).alias("oid"), paths.cache_key(F.concat(F.lit("store/manifests/m"), k.cast("string"))).alias("cache"), paths.format_stub(paths.parse_stub(kept)).alias("stub_text"),
    )


@query("SELECT t.rel_path, r.manifest_key, r.state FROM tree t LEFT JOIN remote_side r ON r.rel_path = t.rel_path", "tree remote_side")
def exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    """S11"""
    return namespace.lookup(load(spark, d, "remote_side").select("rel_path", "manifest_key", "state"), load(spark, d, "tree").select("rel_path"), "rel_path")


@query("SELECT DISTINCT source AS root FROM tree ORDER BY root", "tree")
def root_list(spark: SparkSession, d: str) -> DataFrame:
    """Roots in byte order."""
    return namespace.roots(load(spark, d, "tree").withColumnRenamed("rel_path", "path"))


@query("SELECT rel_path, size FROM tree", "tree")
def local_set(spark: SparkSession, d: str) -> DataFrame:
    """The set of a clean tree; clashes fail the scan."""
    return tables.local_set(load(spark, d, "tree").select("rel_path", "size"))


#: What a walk keeps of the listing, by the policy for links.
_WALK = """kept AS (SELECT * FROM tree_entries e WHERE doc_id % 10 NOT IN (4, 5, 6, 9) AND NOT (doc_id % 10 IN (2, 3) AND (doc_id - doc_id % 10) % 50 = 0)),
found AS (SELECT rel_path, 'file' AS kind FROM kept WHERE kind = 'file' {links}),
dirs AS (SELECT rel_path, 'empty_dir' AS kind FROM kept k WHERE kind = 'directory' AND NOT EXISTS (SELECT 1 FROM found f WHERE starts_with(f.rel_path, concat(k.rel_path, '/'))))
SELECT rel_path, kind FROM found UNION ALL SELECT rel_path, kind FROM dirs"""


@query("WITH " + _WALK.format(links="UNION ALL SELECT rel_path, 'symlink' FROM kept WHERE kind = 'symlink'"), "tree_entries")
def tree_walk_preserving(spark: SparkSession, d: str) -> DataFrame:
    return tables.walk(load(spark, d, "tree_entries").drop("doc_id"), links="preserve")


@query("WITH " + _WALK.format(links=""), "tree_entries")
def tree_walk_skipping(spark: SparkSession, d: str) -> DataFrame:
    return tables.walk(load(spark, d, "tree_entries").drop("doc_id"), links="skip")


@query("WITH " + _WALK.format(links="UNION ALL SELECT l.rel_path, 'file' FROM kept l JOIN kept f ON f.rel_path = l.target AND f.kind = 'file' WHERE l.kind = 'symlink'"), "tree_entries")
def tree_walk_following(spark: SparkSession, d: str) -> DataFrame:
    return tables.walk(load(spark, d, "tree_entries").drop("doc_id"), links="follow")


@query("""SELECT concat('w/0', g::VARCHAR, '/h') AS rel_path, 'file' AS kind FROM (SELECT DISTINCT doc_id // 10 AS g FROM documents WHERE doc_id % 10 = 9)
UNION ALL SELECT concat('w/a', g::VARCHAR, '/f'), 'file' FROM (SELECT DISTINCT doc_id // 10 AS g FROM documents WHERE doc_id % 10 = 9)""")
def tree_walk_linked_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders met first through links, one of them through a link on its target's way; links up, in a cycle and outside."""
    rows = load(spark, d, "linked_entries")
    whole = rows.withColumn("g", F.floor(F.col("doc_id") / 10))
    full = whole.where("doc_id % 10 = 9").select("g")  # a last group that is cut short has no such row
    return tables.walk(whole.join(full, "g", "left_semi").drop("g", "doc_id"), links="follow")


@query("""SELECT doc_id, CASE WHEN mtime = 0 THEN 'unknown' WHEN s >= 86400 THEN concat((s // 86400)::VARCHAR, 'd') WHEN s >= 3600 THEN concat((s // 3600)::VARCHAR, 'h') WHEN s >= 60 THEN concat((s // 60)::VARCHAR, 'm') ELSE '<1m' END AS age,
 CASE WHEN size < 60 THEN concat(size::VARCHAR, 's') WHEN size < 3600 THEN concat((size // 60)::VARCHAR, 'm') WHEN size < 86400 THEN concat((size // 3600)::VARCHAR, 'h') ELSE concat((size // 86400)::VARCHAR, 'd') END AS duration,
 CASE WHEN length(rel_path) > 10 THEN concat(substr(rel_path, 1, 9), '…') ELSE rel_path END AS short, substr(hash, 1, 16) AS prefix, substr(hash, 1, 2) AS shard, concat(rel_path, '.tc') AS stub FROM (SELECT *, greatest(100000 - mtime * 97, 0) AS s FROM (SELECT doc_id, rel_path, size, hash, doc_id AS mtime FROM tree))""", "tree")
def path_texts(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "tree")
    p = F.col("rel_path")
    since = F.when(F.col("mtime") == 0, 0).otherwise(F.col("mtime") * 97)
    return t.select("doc_id", paths.age_text(since, F.lit(100_000)).alias("age"), paths.duration_text(F.col("size")).alias("duration"), paths.truncate(p, 10).alias("short"), paths.hash_prefix(F.col("hash")).alias("prefix"), paths.shard(F.col("hash")).alias("shard"), paths.stub_name(p).alias("stub"))


@query("SELECT doc_id, bytes AS n, CASE WHEN bytes >= 1048576 THEN printf('%.1f MB', bytes / 1048576.0) WHEN bytes >= 1024 THEN printf('%.1f KB', bytes / 1024.0) ELSE concat(bytes::VARCHAR, ' B') END AS shown FROM (SELECT doc_id, size * 1000 AS bytes FROM tree)", "tree")
def byte_texts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "tree").select("doc_id", (F.col("size") * 1000).alias("n")).withColumn("shown", paths.bytes_text(F.col("n")))


@query("SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS endpoint, url AS plain FROM (SELECT page_id, url FROM pages)")
def redacted_endpoints(spark: SparkSession, d: str) -> DataFrame:
    secret = F.concat(F.regexp_replace("url", "^(https?://)", "$1user:pw@"), F.lit("?token=1#x"))
    return read_table(spark, d, "pages").select("page_id", paths.redact_endpoint(secret).alias("endpoint"), F.col("url").alias("plain"))


@query(f"SELECT doc_id, {_SHAPE_FAULTS} AS fault FROM tree", "tree")
def canonical_faults(spark: SparkSession, d: str) -> DataFrame:
    return _shaped(spark, d).select("doc_id", paths.canonical_fault(F.col("rel_path")).alias("fault"))


@query("SELECT doc_id, nfc_normalize(concat(rel_path, 'e', chr(769))) AS path FROM tree", "tree")
def nfc_paths(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "tree").select("doc_id", paths.nfc(F.concat("rel_path", F.lit("e\u0301"))).alias("path"))


@query("SELECT doc_id, concat(lower(rel_path), 'strasse') AS path FROM tree", "tree")
def casefold_paths(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "tree").select("doc_id", paths.casefold(F.concat("rel_path", F.lit("Straße"))).alias("path"))


@query("""SELECT r.rel_path, r.manifest_key, coalesce(t.status, 'not_synced') AS status, t.last_synced FROM remote_side r LEFT JOIN tracked t ON t.rel_path = r.rel_path AND t.manifest_key = r.manifest_key""", "remote_side tracked")
def listing_enriched(spark: SparkSession, d: str) -> DataFrame:
    return namespace.enrich(load(spark, d, "remote_side").select("rel_path", "manifest_key"), load(spark, d, "tracked"))


@query("SELECT rel_path, 'not_synced' AS status FROM remote_side WHERE rel_path NOT IN (SELECT rel_path FROM tracked)", "remote_side tracked")
def discovery(spark: SparkSession, d: str) -> DataFrame:
    return namespace.discover(load(spark, d, "remote_side").select("rel_path"), load(spark, d, "tracked"))


@query("""WITH live AS (SELECT rel_path AS path FROM remote_side WHERE state <> 'deleted'), up AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') AS path FROM live, unnest(range(1, len(string_split(path, '/')))) AS u(i)), wanted AS (SELECT rel_path AS path FROM tree UNION SELECT source FROM tree)
SELECT path, CASE WHEN path IN (SELECT path FROM live) THEN 'file' WHEN path IN (SELECT path FROM up) THEN 'directory' ELSE 'not_found' END AS kind FROM wanted""", "remote_side tree")
def path_attributes(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "tree")
    wanted = t.select(F.col("rel_path").alias("path")).unionByName(t.select(F.col("source").alias("path"))).distinct()
    return namespace.get_attributes(wanted, load(spark, d, "remote_side").select(F.col("rel_path").alias("path"), "state"))


@query("SELECT rel_path AS path, lower(hex(encode(text)[11:30])) AS part FROM tree WHERE rel_path LIKE 'src1/%'", "tree")
def read_slices(spark: SparkSession, d: str) -> DataFrame:
    """M02 with S10: a slice of each file below a folder."""
    rows = namespace.children_of(load(spark, d, "tree").withColumnRenamed("rel_path", "path"), "src1")
    return rows.select("path", F.lower(F.hex(namespace.read_slice(F.col("text"), F.lit(10), F.lit(20)))).alias("part"))


@query("""SELECT doc_id, rel_path = 'src1' OR rel_path LIKE 'src1/%' OR rel_path LIKE 'src2/en/%' AS watched, CASE WHEN rel_path LIKE 'src1/%' THEN substring(rel_path, 6) END AS rest, remote_path LIKE 'store/%' AS "within" FROM tracked""", "tracked")
def prefix_filters(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("rel_path")
    return load(spark, d, "tracked").select("doc_id", namespace.within_roots(p, ["src1", "src2/en"]).alias("watched"), namespace.remainder(p, "src1").alias("rest"), namespace.key_within(F.col("remote_path"), "store").alias("within"))


@query("""WITH met AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS held, b.k IS NOT NULL AS come, struct_pack(id := a.device_id, name := a.name, key := a.public_key, revoked := a.revoked, seq := a.sequence) AS a,
 struct_pack(id := b.device_id, name := b.name, key := b.public_key, revoked := b.revoked, seq := b.sequence) AS b FROM devices a FULL JOIN incoming_devices b ON a.k = b.k),
first AS (SELECT k, NOT held AS added, held AND come AND a.key <> '' AND b.key <> '' AND a.key <> b.key AS clash, CASE WHEN NOT come THEN a WHEN NOT held THEN b WHEN a.key <> '' AND b.key <> '' AND a.key <> b.key THEN a WHEN b.key <> '' AND a.key = '' THEN b
 ELSE struct_pack(id := CASE WHEN a.id = '' THEN b.id ELSE a.id END, name := a.name, key := a.key, revoked := a.revoked OR b.revoked, seq := greatest(a.seq, b.seq)) END AS x FROM met),
again AS (SELECT f.*, c.k IS NOT NULL AND x.name = c.name AS meets, struct_pack(id := c.device_id, name := c.name, key := c.public_key, revoked := c.revoked, seq := c.sequence) AS c FROM first f LEFT JOIN incoming_again c ON c.k = f.k),
rows_of AS (SELECT CASE WHEN meets AND x.key = '' THEN c ELSE x END AS x, added, clash::BIGINT + (meets AND x.key <> '')::BIGINT AS refused FROM again
 UNION ALL SELECT struct_pack(id := c.device_id, name := c.name, key := c.public_key, revoked := c.revoked, seq := c.sequence), true, 0 FROM incoming_again c WHERE c.k NOT IN (SELECT k FROM again WHERE meets))
SELECT x.id AS device_id, x.name AS name, x.key AS public_key, x.revoked AS revoked, x.seq AS sequence, added, refused FROM rows_of""", "devices incoming_devices incoming_again")
def registry_merge(spark: SparkSession, d: str) -> DataFrame:
    """Rows that meet by id alone, by name alone, placeholders that are replaced (and then refuse a second key), ids that are filled."""
    incoming = load(spark, d, "incoming_devices").unionByName(load(spark, d, "incoming_again"))
    return devices.merge_registry(load(spark, d, "devices").drop("k", "capable"), incoming.drop("k"), strict=False).select("device_id", "name", "public_key", "revoked", "sequence", "added", "refused")


@query("""SELECT seq, e.rel_path, CASE WHEN i.state IS NULL THEN 'missing' WHEN i.state = 'deleted' THEN 'deleted' ELSE 'live' END AS "now" FROM log_events e LEFT JOIN (SELECT rel_path, max(CASE WHEN seq % 3 = 0 THEN 'deleted' ELSE 'committed' END) AS state FROM log_events WHERE rel_path IS NOT NULL AND seq % 5 = 0 GROUP BY rel_path) i ON i.rel_path = e.rel_path""", "log_events")
def rebound_events(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "log_events")
    index = e.where("rel_path IS NOT NULL AND seq % 5 = 0").groupBy("rel_path").agg(F.max(F.when(F.col("seq") % 3 == 0, "deleted").otherwise("committed")).alias("state")).withColumn("manifest_key", F.col("rel_path"))
    return namespace.rebind_events(e.select("seq", "rel_path"), index).select("seq", "rel_path", "now")
