"""Ordered deny rules over names and paths (F01-F07, F19): the first rule that matches gives the reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import paths

#: Fixed values of the rules, in the order in which they apply.
SECURITY_DIRS = [".ssh", ".gnupg", "sops-nix"]
SECURITY_FILES = [".credentials.json", "auth.json", ".netrc", ".pgpass", "master.key"]
DATABASE_SUFFIXES = [".sqlite", ".sqlite3", ".sqlite-wal", ".sqlite-shm", ".db", ".db-wal", ".db-shm"]
BUILTIN_DIRS = ["target", "node_modules"]
BUILTIN_FILES = [".DS_Store"]
STUB_EXTENSIONS = ["tc", "tcf"]
#: Name of the marker file that keeps an empty directory (a deployment's own choice).
DIRECTORY_MARKER = ".dir_marker"


def glob_regex(pattern: str) -> str:
    """an anchored regular expression for ``*``, ``?`` and ``[...]`` of a file-name pattern."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "!" else 2))) > 0:
            inner = pattern[i + 1 : end]
            deny = inner[0] == "!"
            out += "[" + "^" * deny + "".join(x if x.isalnum() or x == "-" else "\\" + x for x in inner[deny:]) + "]"
            i = end
        else:
            out += c if c.isalnum() or c == "_" else "\\" + c
        i += 1
    return f"(?s)^{out}$"


def security_file(name: Column) -> Column:
    """the label of a credential, key or live-database file; else null."""
    low = F.lower(name)
    reason = F.lit(None).cast("string")
    for suffix in reversed(DATABASE_SUFFIXES):
        reason = F.when(F.endswith(low, F.lit(suffix)), "live-db").otherwise(reason)
    reason = F.when((low == ".env") | F.startswith(low, F.lit(".env.")) | F.endswith(low, F.lit(".env")), "dotenv").otherwise(reason)
    reason = F.when(low.rlike(r"(?s)^\..*\.tmp\.[0-9a-f]{32}$"), "atomic-write-temp").otherwise(reason)
    reason = F.when(F.endswith(low, F.lit(".rotate-state.json")), "rotation-state").otherwise(reason)
    reason = F.when(F.endswith(low, F.lit(".rotate-pending")), "rotation-pending-key").otherwise(reason)
    for exact in reversed(SECURITY_FILES):
        reason = F.when(low == exact, exact).otherwise(reason)
    return reason


def _security(name: Column) -> Column:
    found = security_file(name)
    for d in reversed(SECURITY_DIRS):
        found = F.when(F.lower(name) == d, d).otherwise(found)
    return F.when(found.isNotNull(), F.concat(F.lit("security: "), found))


def name_reason(name: Column, is_dir: Column, globs: list[str] = (), hidden_dirs: bool = False, git_dirs: bool = False, marker: str = DIRECTORY_MARKER) -> Column:
    """the first rule that denies one name, or null."""
    low = F.lower(name)
    rules = [(_security(name).isNotNull(), _security(name))]
    rules += [(is_dir & (low == d), F.lit(f"built-in: {d}")) for d in BUILTIN_DIRS]
    rules += [(low == f.lower(), F.lit(f"built-in: {f}")) for f in BUILTIN_FILES]
    rules += [(low == marker.lower(), F.lit("directory marker")), (F.coalesce(paths.extension(name).isin(STUB_EXTENSIONS), F.lit(False)), F.lit("stub extension"))]
    rules += [(name.rlike(glob_regex(g)), F.lit(f"glob: {g}")) for g in globs]
    rules += [((low == ".git") & ~is_dir, F.lit("gitfile pointer")), (low == ".git", F.lit(None) if git_dirs else F.lit(".git directory"))]
    if not hidden_dirs:
        rules.append((is_dir & F.startswith(name, F.lit(".")), F.lit("hidden directory")))
    reason = F.lit(None).cast("string")
    for test, label in reversed(rules):
        reason = F.when(test, label).otherwise(reason)
    return reason


def _fences(path: Column) -> Column:
    """Whole-path rules: worktree administration, lock files and undo bundles inside .git."""
    low = F.concat(F.lit("/"), F.lower(path), F.lit("/"))
    return F.when(F.contains(low, F.lit("/.git/worktrees/")), ".git/worktrees admin area").when(low.rlike(r"/\.git/.*\.lock/$"), "git lockfile").when(F.contains(low, F.lit("/.git/undo/")), ".git undo bundle")


def path_reason(path: Column, is_dir: Column, **rules) -> Column:
    """the fences, then F01 on the last component."""
    return F.coalesce(_fences(path), name_reason(paths.name(path), is_dir, **rules))


def component_reason(path: Column, **rules) -> Column:
    """the fences, then F01 on every component, each taken as a directory (so a hidden file is
    denied here and allowed by F02)."""
    found = F.filter(F.transform(paths.components(path), lambda c: name_reason(c, F.lit(True), **rules)), lambda r: r.isNotNull())
    return F.coalesce(_fences(path), F.get(found, F.lit(0)))


def _component_security(path: Column) -> Column:
    return F.get(F.filter(F.transform(paths.components(path), _security), lambda r: r.isNotNull()), F.lit(0))


def security_reason(path: Column) -> Column:
    """the worktree fence and the security rules on every component."""
    low = F.concat(F.lit("/"), F.lower(path), F.lit("/"))
    return F.coalesce(F.when(F.contains(low, F.lit("/.git/worktrees/")), ".git/worktrees admin area"), _component_security(path))


def fixed_ingress_reason(path: Column) -> Column:
    """all fences and the security rules: what no configuration lets in."""
    return F.coalesce(_fences(path), _component_security(path))


#: Fixed values of the inventory's rules (F19), in the order of the rules' own list: components, or runs of components.
DENIED_DIRS = [
    ".cache", ".direnv", ".git", ".gnupg", ".ssh", ".tmp", ".venv", ".claude/worktrees", ".claude/backups", ".codex/cache",
    ".codex/log", ".codex/plugins/cache", ".codex/tmp", ".crush/logs", ".claude/plugins/cache", "cache", "backups", "log",
    "logs", "node_modules", "nix/secrets", "plugins/cache", "sops-nix", "target", "tmp", "worktrees",
]
GENERATED_DIRS = [".artifacts", ".svelte-kit", "build", "dist", "result"]
CREDENTIAL_FILES = [".credentials.json", ".netrc", ".pgpass", "auth.json", "mcp-auth.json", "mcp-needs-auth-cache.json", "session-env"]
DOTENV_FILES, DOTENV_PARTS = [".env", ".envrc"], ".env."
DATABASES, SIDECARS = [".sqlite", ".sqlite3", ".db"], ["-wal", "-shm"]


def _has_run(path: Column, runs: list[str]) -> Column:
    """Whether one of the runs of components stands in a path."""
    whole = F.concat(F.lit("/"), path, F.lit("/"))
    return reduce(lambda a, b: a | b, [F.contains(whole, F.lit(f"/{run}/")) for run in runs])


def _ends(name: Column, suffixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(name, F.lit(x)) for x in suffixes])


def inventory_decision(path: Column, is_symlink: Column, snapshot_databases: bool = True) -> Column:
    """struct(decision, reason) of a path under an inventory's root; case counts."""
    name = paths.name(path)
    says = lambda decision, reason: F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))
    database = says("snapshot", "sqlite-backup-required") if snapshot_databases else says("deny", "sqlite-excluded-static-profile")
    dotenv = name.isin(DOTENV_FILES) | F.endswith(name, F.lit(".env")) | F.contains(name, F.lit(DOTENV_PARTS))
    return (
        F.when(_has_run(path, DENIED_DIRS), says("deny", "secret-or-runtime-dir"))
        .when(_has_run(path, GENERATED_DIRS), says("deny", "generated-output"))
        .when(name.isin(CREDENTIAL_FILES) | dotenv, says("deny", "credential-or-env"))
        .when(_ends(name, SIDECARS), says("deny", "live-db-sidecar"))
        .when(_ends(name, DATABASES), database)
        .when(F.endswith(name, F.lit(".log")), says("deny", "runtime-log"))
        .when(is_symlink, says("deny", "symlink-deferred"))
        .when(F.endswith(name, F.lit(".jsonl")), says("allow", "append-log-active-writer-check-required"))
        .otherwise(says("allow", "default-allow"))
    )
