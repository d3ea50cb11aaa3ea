"""File-collection tables derived from the driver's tables, by integer arithmetic that any engine repeats.

Each derivation is plain SQL text: Spark runs it with selectExpr, the oracles as a common table
expression.  ``SHA(x)`` stands for the engine's SHA-256 of a text, as lowercase hex.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import read_table

_ID = "cast(doc_id as string)"
_PATH = f"concat(source, '/', lang, '/', {_ID}, '.txt')"
_LOCAL = "CASE WHEN doc_id % 11 = 0 THEN concat(text, '#L') ELSE text END"
_REMOTE = "CASE WHEN doc_id % 13 = 0 THEN concat(text, '#R') ELSE text END"
_NAMES = {
    0: "'/.env'", 1: "'/auth.json'", 2: f"concat('/data/', {_ID}, '.sqlite')", 3: "'/.DS_Store'", 4: f"concat('/', {_ID}, '.tc')",
    5: "'/repo/.git/HEAD'", 6: f"concat('/repo/.git/refs/heads/b', {_ID})", 7: "'/repo/.git/index'", 8: "concat('/repo/.git/objects/pack/pack-', substring(SHA(text), 1, 40), '.pack')",
    9: "'/repo/.git/worktrees/w/HEAD'", 10: "'/repo/.git/index.lock'", 11: f"concat('/target/', {_ID}, '.o')", 12: f"concat('/.ssh/id', {_ID})", 13: f"concat('/.cache/', {_ID})",
    14: f"concat('/node_modules/', {_ID}, '.js')", 15: f"concat('/', {_ID}, '.log')", 16: f"concat('/', {_ID}, '.jsonl')", 17: f"concat('/img/', {_ID}, '.iso')", 18: f"concat('/bin/', {_ID}, '.bin')",
    19: f"concat('/build/', {_ID}, '.txt')", 20: "concat('/repo/.git/objects/pack/pack-', substring(SHA(text), 1, 40), '.idx')", 21: "'/repo/.git/packed-refs'", 22: f"concat('/', {_ID}, '.db-wal')", 23: f"concat('/Data/', {_ID}, '.tmp')",
    24: f"concat('/repo/.git/objects/', substring(SHA(text), 1, 2), '/', substring(SHA(text), 3, 38))",
}
_INVENTORY = "CASE " + " ".join(f"WHEN doc_id % 37 = {k} THEN concat(source, {v})" for k, v in _NAMES.items()) + f" ELSE {_PATH} END"

#: One path for each entry of the inventory's rules, and names that only look like one.
_MIRROR_NAMES = [
    "/.cache/k", "/.direnv/e", "/.git/config", "/.gnupg/k", "/.ssh/id", "/.tmp/x", "/.venv/x", "/.claude/worktrees/a/README.md",
    "/.claude/backups/b", "/.codex/cache/k", "/.codex/log/l", "/.codex/plugins/cache/p", "/.codex/tmp/arg0/prompt",
    "/.crush/logs/l", "/.claude/plugins/cache/p", "/cache/k", "/backups/b", "/log/l", "/logs/l", "/node_modules/pkg/index.js",
    "/nix/secrets/k", "/plugins/cache/p", "/sops-nix/k", "/target/o", "/tmp/t", "/worktrees/w", "/.artifacts/a",
    "/.svelte-kit/s", "/build/b", "/dist/d", "/result/r", "/.credentials.json", "/.netrc", "/.pgpass", "/auth.json",
    "/mcp-auth.json", "/mcp-needs-auth-cache.json", "/session-env", "/.env", "/.envrc", "/.env.local", "/prod.env",
    "/runner.env.j2", "/logs_2.sqlite", "/x.sqlite3", "/x.db", "/logs_2.sqlite-wal", "/x.sqlite-shm", "/x.sqlite3-wal",
    "/x.db-shm", "/any-wal", "/run.log", "/sessions/demo.jsonl", "/src/main.rs", "/nix/secretsx/k", "/nix/x/secrets/k",
    "/secrets/nix/k", "/xcache/y", "/Cache/x", "/envrc", "/my.envx", "/x.dbx", "/x.logs", "/worktrees", "/link",
]
_MIRROR = "CASE " + " ".join(f"WHEN doc_id % {len(_MIRROR_NAMES)} = {k} THEN concat('p', {_ID}, '{v}')" for k, v in enumerate(_MIRROR_NAMES)) + " END"

#: Paths of which three in four are git refs: branch heads, a submodule's heads, packed refs.
_GIT_PATH = f"CASE doc_id % 4 WHEN 0 THEN concat(source, '/repo/.git/refs/heads/b', {_ID}) WHEN 1 THEN concat(source, '/repo/.git/modules/m/refs/heads/b', {_ID}) WHEN 2 THEN concat(source, '/r', {_ID}, '/.git/packed-refs') ELSE {_PATH} END"
_UP = "cast(doc_id - doc_id % 10 as string)"
#: A listing of a tree: folders d0, d10, ... with files, denied names, a denied folder and links; folders e7, e17, ... with an empty one.
_ENTRY = f"""CASE doc_id % 10 WHEN 0 THEN concat('t/d', {_ID}) WHEN 1 THEN concat('t/l', {_ID}) WHEN 2 THEN concat('t/d', {_UP}, CASE WHEN (doc_id - 2) % 50 = 0 THEN '/.netrc' ELSE concat('/f', {_ID}) END) WHEN 3 THEN concat('t/d', {_UP}, CASE WHEN (doc_id - 3) % 50 = 0 THEN '/.pgpass' ELSE concat('/f', {_ID}) END)
 WHEN 4 THEN concat('t/d', {_UP}, '/.env') WHEN 5 THEN concat('t/d', {_UP}, '/node_modules') WHEN 6 THEN concat('t/d', {_UP}, '/node_modules/', {_ID}, '.js') WHEN 7 THEN concat('t/e', {_ID}) WHEN 8 THEN concat('t/e', cast(doc_id - 1 as string), '/sub') ELSE concat('t/d', {_UP}, '/s') END"""

#: name: (driver table, columns, condition)
TABLES: dict[str, tuple[str, list[str], str]] = {
    "tree": ("documents", ["doc_id", f"{_PATH} AS rel_path", "n_chars AS size", "doc_id AS mtime", "text", "SHA(text) AS hash", "source", "lang"], "true"),
    "local_side": ("documents", ["doc_id", f"{_PATH} AS rel_path", f"SHA({_LOCAL}) AS hash", "1 + doc_id % 3 AS ca", "doc_id % 2 AS cb"], "doc_id % 7 <> 0"),
    "remote_side": ("documents", ["doc_id", f"{_PATH} AS rel_path", f"concat('m', {_ID}) AS manifest_key", f"SHA({_REMOTE}) AS hash", "1 + doc_id % 2 AS ca", "doc_id % 3 AS cb", "CASE WHEN doc_id % 10 = 0 THEN 'deleted' ELSE 'committed' END AS state"], "doc_id % 5 <> 0 OR doc_id % 10 = 0"),
    "tracked": ("documents", ["doc_id", f"{_PATH} AS rel_path", "SHA(text) AS hash", "CASE doc_id % 10 WHEN 6 THEN 'not_synced' WHEN 7 THEN 'active' WHEN 8 THEN 'locked' WHEN 9 THEN 'conflict' ELSE 'synced' END AS status", "doc_id * 3600 AS last_synced", "n_chars + CASE WHEN doc_id % 17 = 1 THEN 1 ELSE 0 END AS size", "doc_id + CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END AS mtime", f"CASE WHEN doc_id % 10 = 9 THEN concat('c', {_ID}) END AS conflict", "doc_id % 4 = 0 AS exempt", "doc_id % 6 <> 0 AS on_disk", "doc_id % 9 = 0 AS dirty", f"CASE WHEN doc_id % 14 = 1 THEN concat('m', cast(doc_id + 1 as string)) ELSE concat('m', {_ID}) END AS manifest_key", f"concat(CASE WHEN doc_id % 8 = 3 THEN 'old/' ELSE 'store/' END, {_PATH}) AS remote_path", f"CASE WHEN doc_id % 8 <> 5 THEN {_PATH} WHEN doc_id % 3 = 1 THEN concat('/tmp/', {_ID}) WHEN doc_id % 16 = 5 THEN concat('/private/tmp/', {_ID}) ELSE concat('/tmpfoo/', {_ID}) END AS path"], "doc_id % 3 <> 0"),
    "inventory": ("documents", ["doc_id", f"{_INVENTORY} AS path", "n_chars AS size", "doc_id % 31 = 0 AS is_symlink", "SHA(text) AS hash"], "true"),
    "mirror_rows": ("documents", ["doc_id", f"{_MIRROR} AS path", f"doc_id % {len(_MIRROR_NAMES)} = {len(_MIRROR_NAMES) - 1} OR doc_id % 7 = 0 AS is_symlink"], "true"),
    "git_local": ("documents", ["doc_id", f"{_GIT_PATH} AS rel_path", f"SHA({_LOCAL}) AS hash", "1 + doc_id % 3 AS ca", "doc_id % 2 AS cb"], "doc_id % 7 <> 0"),
    "git_remote": ("documents", ["doc_id", f"{_GIT_PATH} AS rel_path", f"SHA({_REMOTE}) AS hash", "1 + doc_id % 2 AS ca", "doc_id % 3 AS cb", "CASE WHEN doc_id % 10 < 4 THEN 'deleted' ELSE 'committed' END AS state"], "doc_id % 5 <> 4"),
    "git_tracked": ("documents", ["doc_id", f"{_GIT_PATH} AS rel_path", "SHA(text) AS hash"], "doc_id % 3 <> 0"),
    "tree_entries": ("documents", ["doc_id", f"{_ENTRY} AS rel_path", "CASE doc_id % 10 WHEN 0 THEN 'directory' WHEN 5 THEN 'directory' WHEN 7 THEN 'directory' WHEN 8 THEN 'directory' WHEN 1 THEN 'symlink' WHEN 9 THEN 'symlink' ELSE 'file' END AS kind", f"CASE doc_id % 10 WHEN 1 THEN concat('t/d', {_UP}, '/f', cast(doc_id + CASE WHEN doc_id % 20 = 1 THEN 1 ELSE 2 END as string)) WHEN 9 THEN '/home/x/.ssh/id' END AS target"], "true"),
    "linked_entries": ("documents", ["doc_id", "replace(CASE doc_id % 10 WHEN 0 THEN 'w/a@' WHEN 1 THEN 'w/z@' WHEN 2 THEN 'w/z@/f' WHEN 3 THEN 'w/z@/sub' WHEN 4 THEN 'w/z@/sub/h' WHEN 5 THEN 'w/z@/up' WHEN 6 THEN 'w/c@' WHEN 7 THEN 'w/d@' WHEN 8 THEN 'w/0@' ELSE 'w/o@' END, '@', cast(cast((doc_id - doc_id % 10) / 10 as int) as string)) AS rel_path", "CASE WHEN doc_id % 10 IN (1, 3) THEN 'directory' WHEN doc_id % 10 IN (2, 4) THEN 'file' ELSE 'symlink' END AS kind", "replace(CASE doc_id % 10 WHEN 0 THEN 'w/z@' WHEN 5 THEN 'w/z@' WHEN 6 THEN 'w/d@' WHEN 7 THEN 'w/c@' WHEN 8 THEN 'w/a@/sub' WHEN 9 THEN '/outside/x' END, '@', cast(cast((doc_id - doc_id % 10) / 10 as int) as string)) AS target"], "true"),
    "policy_rows": ("documents", ["source AS folder", "CASE length(source) % 2 WHEN 0 THEN 'on_demand' ELSE 'always' END AS sync_mode", "cast(2000 as bigint) AS download_threshold"], "true"),
    "policy_overrides": ("documents", ["concat(source, '/de') AS folder", "'never' AS sync_mode", "cast(NULL as bigint) AS download_threshold"], "lang = 'de'"),
    "log_events": ("events", ["event_id AS seq", "concat('dev', cast(user_id % 8 as string)) AS device_id", "CASE event_type WHEN 'click' THEN 'file_synced' WHEN 'view' THEN 'file_synced' WHEN 'purchase' THEN 'conflict_resolved' WHEN 'error' THEN 'file_deleted' ELSE 'device_online' END AS type", "CASE WHEN event_type = 'signup' THEN NULL WHEN event_id % 19 = 0 THEN concat('u', cast(user_id as string), '/.ssh/key') ELSE concat('u', cast(user_id as string), '/f', cast(event_id % 7 as string)) END AS rel_path", "user_id", "event_type", "event_id"], "true"),
    "trash": ("orders", ["concat('p', cast(o_custkey as string)) AS path", "cast(o_orderkey as string) AS trash_key", "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderkey * 3600 END AS trashed_at", "concat('h', cast(o_orderkey % 3 as string)) AS hash", "o_custkey"], "true"),
    "devices": ("supplier", ["s_suppkey AS k", "CASE WHEN s_suppkey % 10 = 7 THEN '' ELSE cast(s_suppkey as string) END AS device_id", "s_name AS name", "CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('k', cast(s_suppkey as string)) END AS public_key", "s_suppkey % 4 = 0 AS placeholder", "s_suppkey % 5 = 0 AS revoked", "s_suppkey AS sequence", "s_suppkey % 3 <> 0 AS capable", "s_suppkey AS position"], "s_suppkey % 6 <> 0"),
    "incoming_devices": ("supplier", ["s_suppkey AS k", "CASE WHEN s_suppkey % 9 = 1 AND s_suppkey % 2 = 1 THEN concat('x', cast(s_suppkey as string)) ELSE cast(s_suppkey as string) END AS device_id", "CASE WHEN s_suppkey % 2 = 0 THEN concat('d', cast(s_suppkey as string)) ELSE s_name END AS name", "CASE WHEN s_suppkey % 11 = 3 THEN '' WHEN s_suppkey % 7 = 0 THEN 'other' ELSE concat('k', cast(s_suppkey as string)) END AS public_key", "s_suppkey % 11 = 3 AS placeholder", "s_suppkey % 8 = 0 AS revoked", "s_suppkey + CASE WHEN s_suppkey % 3 = 0 THEN -3 ELSE 3 END AS sequence", "s_suppkey AS position"], "s_suppkey % 5 <> 0"),
    "incoming_again": ("supplier", ["s_suppkey AS k", "concat('y', cast(s_suppkey as string)) AS device_id", "concat('d', cast(s_suppkey as string)) AS name", "concat('z', cast(s_suppkey as string)) AS public_key", "false AS placeholder", "false AS revoked", "s_suppkey + 9 AS sequence", "s_suppkey + 1000000000 AS position"], "s_suppkey % 16 = 0"),
    "push_log": ("lineitem", ["l_orderkey * 10 + l_linenumber AS seq", "concat('p', cast(l_partkey as string)) AS path", "cast(l_quantity as bigint) AS chunks", "cast(l_quantity as bigint) * 1000 AS bytes", "CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE cast(l_quantity as bigint) * 900 END AS uploaded_bytes", "l_partkey % 977 AS elapsed_ms", "l_orderkey * 60 + l_linenumber AS ts", "4 + 4 * (l_linenumber % 3) AS concurrency", "concat('p', cast(l_partkey as string), CASE l_partkey % 5 WHEN 0 THEN '.pack' WHEN 1 THEN '.idx' ELSE '' END) AS file", "CASE l_returnflag WHEN 'R' THEN 'true' WHEN 'A' THEN 'false' END AS flag", "l_partkey", "l_suppkey", "l_linenumber", "l_orderkey"], "true"),
    "commits": ("orders", ["concat('n', cast(o_orderkey as string)) AS child", "concat('n', cast(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey / 2 ELSE (o_orderkey - 1) / 2 END as bigint)) AS parent"], "o_orderkey > 1"),
}


def _spark_text(sql: str) -> str:
    return re.sub(r"SHA\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", r"sha2(\1, 256)", sql)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns, where = TABLES[name]
    found = read_table(spark, sf_dir, table).where(where).selectExpr(*map(_spark_text, columns))
    if name in ("local_side", "remote_side", "git_local", "git_remote"):
        found = found.withColumn("clock", F.create_map(F.lit("a"), "ca", F.lit("b"), "cb").cast("map<string,bigint>"))
    return found


def cte(*names: str) -> str:
    """The tables as common table expressions of an oracle."""
    parts = []
    for name in names:
        table, columns, where = TABLES[name]
        parts.append(f"{name} AS (SELECT {', '.join(columns)} FROM {table} WHERE {where})".replace("SHA(", "sha256("))
    return ",\n".join(parts)


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "policy_rows").unionByName(load(spark, sf_dir, "policy_overrides")).distinct()


POLICIES = "policies AS (SELECT DISTINCT * FROM (SELECT * FROM policy_rows UNION ALL SELECT * FROM policy_overrides))"
