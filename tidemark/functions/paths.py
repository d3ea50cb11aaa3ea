"""Path expressions (P01-P16, V05, V12, H02) as native columns; Unicode forms as pandas UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Names that Windows reserves, characters that it forbids in a component.
WINDOWS_DEVICES = r"(?i)^(con|prn|aux|nul|com[1-9¹²³]|lpt[1-9¹²³])(\..*)?$"
WINDOWS_FORBIDDEN = r'[<>:"|?*]'
#: Components below .git that must keep their exact spelling.
GIT_COMPONENTS = """
refs objects modules worktrees info pack hooks logs heads tags remotes HEAD FETCH_HEAD ORIG_HEAD MERGE_HEAD
CHERRY_PICK_HEAD REVERT_HEAD BISECT_LOG packed-refs index config config.worktree commondir alternates http-alternates
index.lock HEAD.lock packed-refs.lock shallow shallow.lock multi-pack-index commit-graph
""".split()


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC (no built-in function has it)."""
    import unicodedata

    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full Unicode case folding, then NFC."""
    import unicodedata

    return s.map(lambda x: unicodedata.normalize("NFC", x.casefold()), na_action="ignore")


def components(path: Column) -> Column:
    return F.split(path, "/")


def name(path: Column) -> Column:
    return F.element_at(components(path), -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the name, if the dot is not its first character; else null."""
    found = F.regexp_extract(name(path), r"^.+\.([^.]*)$", 1)
    return F.when(found != "", found)


def normalise(path: Column) -> Column:
    """Forward slashes and NFC."""
    return nfc(F.replace(path, F.lit("\\"), F.lit("/")))


def relative(path: Column, root: Column) -> Column:
    """Without the root's prefix, or without leading slashes where it is not below the root."""
    slash = F.replace(path, F.lit("\\"), F.lit("/"))
    below = F.startswith(slash, F.concat(root, F.lit("/")))
    return F.when(root.isNotNull() & below, F.substr(slash, F.length(root) + 2)).otherwise(F.regexp_replace(slash, "^/+", ""))


def ancestors(path: Column) -> Column:
    """Proper ancestors, nearest last: a/b/c gives [a, a/b]; none for a single component."""
    parts = components(path)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def repo_root(path: Column) -> Column:
    """The part before the first .git component ("" at the root); null outside a repository."""
    parts = components(F.replace(path, F.lit("\\"), F.lit("/")))
    at = F.array_position(parts, ".git")
    return F.when(at > 0, F.array_join(F.filter(F.slice(parts, 1, (at - 1).cast("int")), lambda c: c != ""), "/"))


def head_ref(path: Column) -> Column:
    """refs/heads/<branch> of a branch file under .git/refs/heads/; else null."""
    slash = F.replace(path, F.lit("\\"), F.lit("/"))
    at = F.instr(slash, ".git/refs/heads/")
    branch = F.substr(slash, at + len(".git/refs/heads/"))
    return F.when((at > 0) & (branch != "") & ~F.endswith(branch, F.lit("/")), F.concat(F.lit("refs/heads/"), branch))


def is_git_internal(path: Column) -> Column:
    return F.array_contains(components(path), ".git")


def is_git_ref_class(path: Column) -> Column:
    """Refs, packed-refs and HEAD, of a repository or of a submodule's directory."""
    low = F.lower(path)
    own = F.contains(low, F.lit(".git/refs/")) | F.endswith(low, F.lit(".git/packed-refs")) | F.endswith(low, F.lit(".git/head"))
    return is_git_internal(path) & (own | low.rlike(r"\.git/modules(?=/).*(/refs/|/packed-refs$|/head$)"))


def is_git_object_class(path: Column) -> Column:
    """Loose objects and pack payloads, whose names come from their content."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    tail = F.regexp_extract(low, r"^(?:(?!\.git/).)*\.git/(?:objects/|modules/.+/objects/)((?:(?!/objects/).)*)$", 1)
    return tail.rlike(r"^[0-9a-f]{2}/([0-9a-f]{38}|[0-9a-f]{62})$") | tail.rlike(r"^pack/pack-([0-9a-f]{40}|[0-9a-f]{64})\.(pack|idx|rev)$")


def is_git_object_routing(path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.endswith(low, F.lit("/objects/info/alternates")) | F.endswith(low, F.lit("/objects/info/http-alternates"))


def ref_sha(content: Column) -> Column:
    """The first token if it is 40 or 64 hex digits; symbolic refs give null."""
    found = F.regexp_extract(content, r"^\s*([0-9a-fA-F]{64}|[0-9a-fA-F]{40})(\s|$)", 1)
    return F.when(found != "", found)


def stub_name(path: Column) -> Column:
    """A placeholder's name."""
    return F.concat(path, F.lit(".tc"))


def real_name(path: Column) -> Column:
    """The name behind a placeholder (.tc or .tcf); others stay."""
    return F.regexp_replace(path, r"\.(tc|tcf)$", "")


def is_stub(path: Column) -> Column:
    return F.coalesce(extension(path).isin("tc", "tcf"), F.lit(False))


def parse_stub(content: Column) -> Column:
    """``key value`` lines to a map; lines without a value and repeated keys' earlier values go."""
    lines = F.filter(F.split(content, "\n"), lambda x: F.instr(x, " ") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, " ", 1).alias("k"), F.substr(x, F.instr(x, " ") + 1).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])))


def format_stub(fields: Column) -> Column:
    """Version first, then the other keys in order."""
    entries = F.array_sort(F.map_entries(F.map_filter(fields, lambda k, _: k != "version")))
    rest = F.transform(entries, lambda e: F.concat(e["key"], F.lit(" "), e["value"], F.lit("\n")))
    return F.concat(F.lit("version "), F.coalesce(F.try_element_at(fields, F.lit("version")), F.lit("1")), F.lit("\n"), F.array_join(rest, ""))


def oid_hex(oid: Column) -> Column:
    """The digits of ``algorithm:hex``; null without an algorithm."""
    found = F.regexp_extract(oid, r"^[a-z0-9]+:(.+)$", 1)
    return F.when(found != "", found)


def cache_key(manifest_path: Column) -> Column:
    """P10"""
    return name(manifest_path)


def shard(key: Column) -> Column:
    """The first two characters; xx for shorter keys."""
    return F.when(F.length(key) >= 2, F.substring(key, 1, 2)).otherwise("xx")


def hash_prefix(digest: Column) -> Column:
    """P12"""
    return F.substring(digest, 1, 16)


def age_text(since: Column, now: Column) -> Column:
    """3d / 4h / 5m / <1m; 0 is unknown; a future time counts as now."""
    s = F.greatest(now - since, F.lit(0))
    whole = lambda unit: F.floor(s / unit).cast("string")
    return F.when(since == 0, "unknown").when(s >= 86400, F.concat(whole(86400), F.lit("d"))).when(s >= 3600, F.concat(whole(3600), F.lit("h"))).when(s >= 60, F.concat(whole(60), F.lit("m"))).otherwise("<1m")


def duration_text(s: Column) -> Column:
    """Whole seconds, minutes, hours or days."""
    whole = lambda unit: F.floor(s / unit).cast("string")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(whole(60), F.lit("m"))).when(s < 86400, F.concat(whole(3600), F.lit("h"))).otherwise(F.concat(whole(86400), F.lit("d")))


def bytes_text(n: Column) -> Column:
    """B, or KB, MB, GB with one decimal."""
    scaled = lambda unit, label: F.concat(F.format_string("%.1f", F.bround(n / F.lit(float(unit)), 1)), F.lit(f" {label}"))
    return F.when(n >= 1 << 30, scaled(1 << 30, "GB")).when(n >= 1 << 20, scaled(1 << 20, "MB")).when(n >= 1 << 10, scaled(1 << 10, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def truncate(s: Column, n: int) -> Column:
    """The first n - 1 characters and an ellipsis where the text is longer than n."""
    if n == 0:
        return F.when(s.isNotNull(), F.lit(""))
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s)


def redact_endpoint(url: Column) -> Column:
    """Scheme, host and port alone; null for what is no http(s) URL."""
    found = F.regexp_replace(url, r"^(https?://)(?:[^/@?#]*@)?([^/?#]*).*$", "$1$2")
    return F.when(url.rlike(r"^https?://[^/?#]+"), found)


def chunk_profile(path: Column) -> Column:
    """The chunk-size profile of a path: small, pack or large."""
    parts, ext = components(path), extension(path)
    in_pack = F.concat(F.lit("/"), path, F.lit("/")).contains("/.git/objects/pack/")
    index = F.concat(F.lit("/"), path).rlike(r"/\.git/index$") & (F.size(parts) >= 2)
    return (
        F.when(index, "pack")
        .when(in_pack & F.startswith(name(path), F.lit("tmp_pack_")), "large")
        .when((ext == "idx") & in_pack, "large")
        .when(ext.isin("pack", "rev", "iso", "img"), "large")
        .when(ext.isin("idx", "bin"), "pack")
        .otherwise("small")
    )


def canonical_fault(path: Column) -> Column:
    """Why a relative path is not canonical (first fault), or null.  The NFC test is the second; a path of
    ASCII characters has passed it, so only others meet the UDF's answer."""
    parts = components(path)
    any_part = lambda test: F.exists(parts, test)
    at = F.array_position(parts, ".git")
    below_git = F.when(at > 0, F.slice(parts, (at + 1).cast("int"), F.size(parts))).otherwise(F.array().cast("array<string>"))
    exact = F.array(*[F.lit(c) for c in GIT_COMPONENTS])
    folded = F.array(*[F.lit(c.lower()) for c in GIT_COMPONENTS])
    return (
        F.when((path == "") | F.startswith(path, F.lit("/")) | F.contains(path, F.lit("\\")) | path.rlike(r"\p{Cc}"), "not_relative")
        .when(path.rlike(r"[^\x00-\x7f]") & (nfc(path) != path), "not_nfc")
        .when(any_part(lambda c: c.isin("", ".", "..")), "dot_component")
        .when(any_part(lambda c: c.rlike(r"[. ]$")), "trailing_dot_or_space")
        .when(any_part(lambda c: c.rlike(WINDOWS_FORBIDDEN)), "forbidden_character")
        .when(any_part(lambda c: c.rlike(WINDOWS_DEVICES)), "device_name")
        .when(any_part(lambda c: c.rlike(r"(?i)^git~[0-9]+$")), "git_short_name")
        .when(any_part(lambda c: (F.lower(c) == ".git") & (c != ".git")), "git_alias")
        .when(F.exists(below_git, lambda c: F.array_contains(folded, F.lower(c)) & ~F.array_contains(exact, c)), "git_metadata_alias")
        .when(F.exists(below_git, lambda c: F.endswith(F.lower(c), F.lit(".lock")) & ~F.endswith(c, F.lit(".lock"))), "git_lock_alias")
    )


def is_key_component(value: Column) -> Column:
    """One safe component of a storage key."""
    return value.rlike(r"^[^/\\\p{Cc}]+\z") & ~value.isin(".", "..")
