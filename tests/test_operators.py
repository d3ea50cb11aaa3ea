"""Properties and edge cases that the driver's tables do not hold."""

import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import clocks, ingress, paths
from tidemark.operators import cas, conflicts, devices, lifecycle, namespace, reconcile, trees
from tidemark.sources import tables
from tidemark.streaming import events as ev

CLOCK = "map<string,bigint>"


def random_clocks(n, seed):
    rng = random.Random(seed)
    one = lambda: {rng.choice("abcd"): rng.randint(0, 3) for _ in range(rng.randint(0, 4))}
    return [(one(), one(), one()) for _ in range(n)]


def test_clock_laws(spark):
    """Merge is commutative, associative and idempotent and dominates; compare is antisymmetric; tick advances."""
    df = spark.createDataFrame(random_clocks(400, 1), f"x {CLOCK}, y {CLOCK}, z {CLOCK}")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    m, text = clocks.merge, clocks.text
    rows = df.select(
        (text(m(x, y)) == text(m(y, x))).alias("commutative"),
        (text(m(m(x, y), z)) == text(m(x, m(y, z)))).alias("associative"),
        (text(m(x, x)) == text(x)).alias("idempotent"),
        clocks.compare(m(x, y), x).isin("greater", "equal").alias("dominates"),
        ((clocks.compare(x, y) == "greater") == (clocks.compare(y, x) == "less")).alias("antisymmetric"),
        (clocks.is_concurrent(x, y) == clocks.is_concurrent(y, x)).alias("symmetric"),
        (clocks.compare(clocks.tick(x, F.lit("a")), x) == "greater").alias("advances"),
    )
    for r in rows.collect():
        assert all(r.asDict().values()), r


def test_clock_edges(spark):
    df = spark.createDataFrame([({"a": 1, "z": 0}, {"a": 1}), ({}, {}), (None, {"a": 1}), (None, None)], f"x {CLOCK}, y {CLOCK}")
    assert [r[0] for r in df.select(clocks.compare(F.col("x"), F.col("y"))).collect()] == ["equal", "equal", "less", "equal"]


def side(spark, rows, cols):
    return spark.createDataFrame(rows, cols)


def test_reconcile_cells(spark):
    """All presence cells, git refs, tombstones, content equal under any clocks, and the inferred tick."""
    local = side(spark, [("new", "h", {}), ("same", "h", {"a": 9}), ("r/.git/refs/heads/x", "h2", {}), ("gone", "h", {}), ("tick", "h2", {"a": 1}), ("tie", "h1", {"a": 1})], f"rel_path string, hash string, clock {CLOCK}")
    remote = side(spark, [("there", "h", {}, "committed"), ("orphan", "h", {}, "committed"), ("same", "h", {"b": 1}, "committed"), ("gone", None, None, "deleted"), ("tick", "h3", {"a": 1, "b": 1}, "committed"), ("tie", "h2", {"a": 1}, "committed")], f"rel_path string, hash string, clock {CLOCK}, state string")
    tracked = side(spark, [("orphan", "h"), ("r/.git/refs/heads/x", "h1"), ("gone", "h"), ("ghost", "h"), ("tick", "h1")], "rel_path string, hash string")
    got = {r.rel_path: (r.action, r.reason) for r in reconcile.plan(local, remote, tracked, "a").collect()}
    assert got == {"new": ("push", "new_local"), "there": ("pull", "new_remote"), "orphan": ("up_to_date", "up_to_date"), "same": ("up_to_date", "up_to_date"), "r/.git/refs/heads/x": ("push", "local_newer"), "gone": ("up_to_date", "up_to_date"), "ghost": ("up_to_date", "up_to_date"), "tick": ("conflict", "conflict"), "tie": ("conflict", "conflict")}
    got = {r.rel_path: r.action for r in reconcile.plan(local, remote, tracked, "a", delete_local_orphans=True, delete_remote_orphans=True).collect()}
    assert got["gone"] == "delete_local" and got["orphan"] == "delete_remote"


def test_reconcile_empty(spark):
    empty = side(spark, [], f"rel_path string, hash string, clock {CLOCK}")
    remote = side(spark, [], f"rel_path string, hash string, clock {CLOCK}, state string")
    assert reconcile.plan(empty, remote, side(spark, [], "rel_path string, hash string"), "a").count() == 0


def test_deny_rules(spark):
    """A hidden file, and a file named like a build folder, are denied by component but allowed by path."""
    names = [".bashrc", "target", "src/target/x", "a/.ssh/id", "b/.env.local", "c/x.sqlite", "d/.git", "d/.git/index.lock", "Cargo.lock", "e/.x.tmp." + "0" * 32, "f/y.tc", "g/n.tmp", "ok.txt"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    by_path = [r[0] for r in df.select(ingress.path_reason(F.col("p"), F.lit(False), globs=["*.tmp"])).collect()]
    by_part = [r[0] for r in df.select(ingress.component_reason(F.col("p"), globs=["*.tmp"])).collect()]
    assert by_path == [None, None, None, None, "security: dotenv", "security: live-db", "gitfile pointer", "git lockfile", None, "security: atomic-write-temp", "stub extension", "glob: *.tmp", None]
    assert by_part == ["hidden directory", "built-in: target", "built-in: target", "security: .ssh", "security: dotenv", "security: live-db", ".git directory", "git lockfile", None, "security: atomic-write-temp", "stub extension", "glob: *.tmp", None]


@given(st.text(alphabet="ab.*?[]!-_", max_size=8), st.text(alphabet="ab.-_x", max_size=8))
@settings(max_examples=200, deadline=None)
def test_glob_is_a_regex(pattern, name):
    import re

    try:
        re.compile(ingress.glob_regex(pattern))
    except re.error as e:
        assert "bad character range" in str(e)  # as [b-a], which no name matches
        return
    if not any(c in pattern for c in "*?["):
        assert bool(re.match(ingress.glob_regex(pattern), name)) == (pattern == name)


def test_unicode_paths(spark):
    df = spark.createDataFrame([("Straße/é",), (None,)], "p string")
    assert [r[0] for r in df.select(paths.casefold("p")).collect()] == ["strasse/é", None]
    assert df.select(paths.normalise(F.col("p"))).first()[0] == "Straße/é"
    df = spark.createDataFrame([("a/b",), ("",), ("/a",), ("a//b",), ("a/../b",), ("a/b.",), ("x:y",), ("nul",), ("GIT~1",), ("r/.Git/x",), ("r/.git/Refs/x",), ("r/.git/y.LOCK",)], "p string")
    assert [r[0] for r in df.select(paths.canonical_fault(F.col("p"))).collect()] == [None, "not_relative", "not_relative", "dot_component", "dot_component", "trailing_dot_or_space", "forbidden_character", "device_name", "git_short_name", "git_alias", "git_metadata_alias", "git_lock_alias"]


def test_path_functions(spark):
    df = spark.createDataFrame([("root/a\\b", "root"), ("/x/y", None)], "p string, r string")
    assert [r[0] for r in df.select(paths.relative(F.col("p"), F.col("r"))).collect()] == ["a/b", "x/y"]
    one = spark.range(1)
    assert one.select(paths.ref_sha(F.lit("a" * 40 + "\n"))).first()[0] == "a" * 40
    assert one.select(paths.ref_sha(F.lit("ref: refs/heads/x"))).first()[0] is None
    stub = "version 2\nsize 5\nbad\nsize 6\noid sha256:ab\n"
    m = one.select(paths.parse_stub(F.lit(stub))).first()[0]
    assert m == {"version": "2", "size": "6", "oid": "sha256:ab"}
    assert one.select(paths.format_stub(paths.parse_stub(F.lit(stub)))).first()[0] == "version 2\noid sha256:ab\nsize 6\n"
    assert one.select(paths.oid_hex(F.lit("sha256:ab")), paths.oid_hex(F.lit("ab"))).first()[:] == ("ab", None)
    assert one.select(paths.chunk_profile(F.lit("r/.git/objects/pack/tmp_pack_1")), paths.real_name(F.lit("a/b.tcf")), paths.is_stub(F.lit(".tc"))).first()[:] == ("large", "a/b", False)


@given(st.binary(max_size=60_000))
@settings(max_examples=40, deadline=None)
def test_chunks_cover(data):
    """Contiguous cover, sizes within bounds, deterministic; nothing for empty input."""
    least, average, most = cas.PROFILES["small"]
    ends = cas.cut_points(data, least, average, most)
    assert ends == cas.cut_points(data, least, average, most)
    sizes = [e - s for s, e in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
    assert sum(sizes) == len(data) and all(0 < s <= most for s in sizes) and all(s >= least for s in sizes[:-1])


@given(st.integers(0, 60_000), st.integers(), st.lists(st.integers(1, 9000), min_size=1, max_size=12))
@settings(max_examples=25, deadline=None)
def test_chunks_do_not_depend_on_pieces(n, seed, sizes):
    """Any pieces, down to single bytes, give the boundaries of the whole file."""
    data = random.Random(seed).randbytes(n)
    chunker, ends, at, found = cas.Chunker(*cas.PROFILES["small"]), [], 0, []
    for size in [*sizes, len(data)]:
        found += chunker.feed(data[at : at + size])
        at += size
    found += chunker.finish()
    for chunk in found:
        ends.append((ends[-1] if ends else 0) + len(chunk))
    assert b"".join(found) == data and ends == cas.cut_points(data, *cas.PROFILES["small"])


def test_chunks_by_the_rule():
    """Boundaries equal those of a byte-by-byte rolling hash, across windows too."""
    rng = random.Random(6)
    data = rng.randbytes(cas.WINDOW + 50_000)
    least, average, most = cas.PROFILES["small"]
    table, bits, h, hashes = [int(x) for x in cas.gear_table()], average.bit_length() - 1, 0, []
    for b in data:
        h = (h * 2 + table[b]) % 2**32
        hashes.append(h)
    ends, start = [], 0
    while start < len(data):
        end = min(start + most, len(data))
        for i in range(start + least, end):
            if hashes[i] >> (31 - bits if i < start + average else 33 - bits) == 0:
                end = i + 1
                break
        ends.append(end)
        start = end
    assert cas.cut_points(data, least, average, most) == ends


def test_blocks_give_the_same_chunks(spark):
    rng = random.Random(7)
    files = [(f"f{i}", rng.randbytes(n), "small") for i, n in enumerate((0, 1, 5000, 70_000))]
    whole = spark.createDataFrame(files, "path string, content binary, profile string")
    blocks = spark.createDataFrame([(p, b, c[i : i + 1000], k) for p, c, k in files for b, i in enumerate(range(0, len(c), 1000))] + [("f1", 7, None, "small")], "path string, block int, content binary, profile string")
    assert sorted(cas.block_chunks(blocks).collect()) == sorted(cas.content_chunks(whole).collect()) and cas.content_chunks(whole).count() > 8


def test_fixed_chunks_are_linear(spark):
    """Four times the text takes about four times the time, not sixteen; characters outside the basic plane are one."""
    import time

    took = []
    for n in (500_000, 500_000, 2_000_000):
        df = spark.range(1).select(F.lit("p").alias("path"), F.repeat(F.lit("añ😀x"), n // 4).alias("content"))
        began = time.perf_counter()
        rows = cas.fixed_chunks(df, 512).agg(F.count("*").alias("n"), F.sum("length").alias("s"), F.max("length").alias("m")).first()
        took.append(time.perf_counter() - began)
        assert (rows.n, rows.s, rows.m) == (-(-n // 512), n, 512)
    assert took[2] < 9 * took[1] + 2


def test_chunks_are_local():
    """An insertion near the front moves few boundaries."""
    rng = random.Random(5)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    x = cas.cut_points(data, *cas.PROFILES["small"])
    old = {hashlib.sha256(data[s:e]).digest() for s, e in zip([0, *x[:-1]], x, strict=True)}
    new = data[:1000] + b"inserted" + data[1000:]
    y = cas.cut_points(new, *cas.PROFILES["small"])
    parts = [hashlib.sha256(new[s:e]).digest() for s, e in zip([0, *y[:-1]], y, strict=True)]
    assert sum(p not in old for p in parts) <= 4


def test_cas_edges(spark):
    """Empty files have no chunk and no frame; a missing chunk shows; ranges read across frames."""
    files = spark.createDataFrame([("e", ""), ("n", None), ("x", "abc" * 1000)], "path string, content string")
    chunks = cas.fixed_chunks(files, 512)
    assert chunks.select("path").distinct().collect()[0].path == "x" and chunks.count() == 6
    m = cas.manifests(chunks)
    short = cas.reassemble(m, chunks.where("pos <> 2")).first()
    assert short.missing == 1
    frames = cas.compress_frames(files, frame_bytes=700)
    assert cas.read_range(frames, 690, 1410).first().content == ("abc" * 1000)[690:1410].encode()
    plan = cas.cleanup_plan(spark.createDataFrame([("a", None), ("b", 0), ("c", 10**9)], "hash string, last_modified bigint"), 100_000, cas.grace(0))
    assert [r.plan for r in plan.orderBy("hash").collect()] == ["skip", "delete", "within_grace"]
    assert cas.grace(0, indexed=False) == 0


def test_frames_are_handed_on_in_bounded_batches(spark):
    """One batch of many long texts, and of frames that open to far more than they hold: no batch on the way out exceeds
    BATCH_BYTES, and the bytes come back in any range."""
    bodies = [*(random.Random(i).randbytes(1 << 20) for i in range(12)), b"", None, bytes(20 << 20)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(bodies))]), pa.array(bodies, pa.binary())], names=["k", "c"])
    framed = list(cas._framed(iter([batch]), 1 << 20, 3))
    assert len(framed) > 2 and all(sum(b.column(3).to_pylist()) <= cas.BATCH_BYTES for b in framed)
    rows = [r for b in framed for r in b.to_pylist()]
    asked = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows]) for c in ("k", "pos", "frame", "uncompressed")] + [pa.array([7] * len(rows)), pa.array([1 << 20] * len(rows))], names=["k", "pos", "frame", "uncompressed", "low", "size"])
    opened = list(cas._opened(iter([asked])))
    assert len(opened) >= 8 and all(sum(map(len, b.column(2).to_pylist())) <= cas.BATCH_BYTES for b in opened)
    got = {(r["k"], r["pos"]): r["_b"] for b in opened for r in b.to_pylist()}
    assert got == {(str(k), i >> 20): x[i + 7 : i + (1 << 20)] for k, x in enumerate(bodies) for i in range(0, len(x or b""), 1 << 20)}
    files = spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in enumerate(bodies)], "path long, content binary")
    whole = cas.read_range(cas.compress_frames(files, frame_bytes=300_000), 1_000, 900_000).collect()
    assert {int(r.path): bytes(r.content) for r in whole} == {i: x[1_000:900_000] for i, x in enumerate(bodies) if x}


def test_debounce_gap(spark):
    """Exactly the gap ends a period; repeated and out-of-order delivery change nothing else."""
    rows = [("p", 0, 1, "created"), ("p", 99, 2, "modified"), ("p", 199, 3, "deleted"), ("q", 5, 4, "created")]
    df = spark.createDataFrame(rows[::-1], "path string, ts_micros bigint, seq bigint, kind string")
    got = sorted((r.path, r.started, r.ended, r.n, r.kind) for r in ev.debounce(df, 100).collect())
    assert got == [("p", 0, 99, 2, "modified"), ("p", 199, 199, 1, "deleted"), ("q", 5, 5, 1, "created")]


@pytest.mark.parametrize("files_a_batch", [None, 1])
def test_rate_limit_in_any_order(spark, tmp_path, files_a_batch):
    """More rows a device than a chunk holds, from shuffled files, in one batch or several: as lockout_log says."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(8)
    rows = [(d, ts, rng.random() < 0.2 and ts < 24_990) for d in ("busy", "late") for ts in range(25_000)] + [("quiet", 1, False), ("never", 3, True)]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "device string, ts long, ok boolean")
    log.repartition(4).write.parquet(f"{tmp_path}/in")
    reader = spark.readStream.schema("device string, ts long, ok boolean")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    limited = reader.parquet(f"{tmp_path}/in").groupBy("device").transformWithStateInPandas(ev.rate_limit_state(), "device string, failures long, locked_until long", "Update", "None")
    limited.writeStream.outputMode("update").foreachBatch(ev.idempotent_writer(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cursor").trigger(availableNow=True).start().awaitTermination()
    spark.conf.set(provider, before)
    found = spark.read.parquet(f"{tmp_path}/out").groupBy("device").agg(F.max_by("failures", "batch").alias("failures"), F.max_by("locked_until", "batch").alias("locked_until"))
    want = {}
    for r in ev.lockout_log(log.withColumnRenamed("ts", "seq")).orderBy("device", "seq").collect():
        until = 0 if r.ok else r.seq + r.lockout_seconds if r.lockout_seconds else want.get(r.device, (0, 0))[1]
        want[r.device] = (r.failures, until)
    assert {r.device: (r.failures, r.locked_until) for r in found.collect()} == want and want["busy"][0] >= 10


def test_replay_is_idempotent(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "y"), ("b", 2, "x")], "rel_path string, seq bigint, type string")
    assert sorted((r.rel_path, r.seq, r.type) for r in ev.latest_by_path(log).collect()) == [("a", 3, "y"), ("b", 2, "x")]


def test_manifest_forms(spark):
    """JSON, the older text form, and malformed JSON (no fall-back)."""
    body = ['{"version":2,"chunks":["c1","c2"],"file_hash":"h","file_size":5,"rel_path":"a"}', "c1\nc2\n\n", '{"version":2,', ""]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(body)], "i int, b string")
    rows = [r.m for r in df.select("i", tables.parse_manifest(F.col("b")).alias("m")).orderBy("i").collect()]
    assert rows[0].chunks == ["c1", "c2"] and rows[0].file_size == 5 and rows[1].chunks == ["c1", "c2"] and rows[1].version == 1 and rows[2].chunks is None and rows[3].chunks == []


def test_scan_fails_whole(spark):
    entries = spark.createDataFrame([("s/index/../x", "manifest_hash=m")], "key string, content string")
    with pytest.raises(Exception, match="unreadable index entry"):
        tables.scan_index(entries, "s").collect()


def test_tree_scan(spark, tmp_path):
    for name in ["a/x.txt", "a/.ssh/id", "b/.env", "c/node_modules/y.js", "d/z.log"]:
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(name)
    found = tables.local_set(tables.scan_tree(spark, str(tmp_path)))
    assert sorted((r.rel_path, r.size) for r in found.select("rel_path", "size").collect()) == [("a/x.txt", 7), ("d/z.log", 7)]
    for names, fault in ((["é", "e\u0301"], "duplicate path"), (["a/X", "a/x"], "paths that differ in case"), (["A", "a/b"], "a file is an ancestor")):
        with pytest.raises(Exception, match=fault):
            tables.local_set(spark.createDataFrame([(n, 1) for n in names], "rel_path string, size int")).collect()


def test_walk_policies(spark):
    """Links to one file count once when followed; links to folders, to nothing and to secrets never; nested empty folders."""
    rows = [("a", "directory", None), ("a/f", "file", None), ("l2", "symlink", "a/f"), ("l1", "symlink", "a/f"), ("loop", "symlink", "a"), ("gone", "symlink", "zz"), ("key", "symlink", "/h/.ssh/id"), ("e", "directory", None), ("e/s", "directory", None), ("e/s/.env", "file", None), (".h", "directory", None), (".h/f", "file", None)]
    df = spark.createDataFrame(rows, "rel_path string, kind string, target string")
    walked = lambda **k: [(r.rel_path, r.kind) for r in tables.walk(df, **k).collect()]
    assert walked() == [("e", "empty_dir"), ("e/s", "empty_dir"), ("a/f", "file")]
    assert walked(links="follow") == [("e", "empty_dir"), ("e/s", "empty_dir"), ("a/f", "file"), ("l1", "file")]
    assert walked(links="preserve", hidden_dirs=True) == [("e", "empty_dir"), ("e/s", "empty_dir"), (".h/f", "file"), ("a/f", "file"), ("gone", "symlink"), ("l1", "symlink"), ("l2", "symlink"), ("loop", "symlink")]


def test_state_files_and_versions(spark, tmp_path):
    good = '{"last_seq": 7, "device_id": "d", "entries": {"p": {"hash": "h", "size": 1, "vclock": {"a": 2}}}}'
    df = spark.createDataFrame([(good,), ('{"q": {"hash": "g", "size": 2, "status": "synced"}}',), ("{}",)], "content string")
    got = {r.path: (r.hash, r.status, r.last_seq, r.owner, r.vclock) for r in tables.scan_state(df).collect()}
    assert got == {"p": ("h", "not_synced", 7, "d", {"a": 2}), "q": ("g", "synced", 0, "", None)}
    with pytest.raises(Exception, match="unreadable state file"):
        tables.scan_state(spark.createDataFrame([("{broken",)], "content string")).collect()
    out = f"file://{tmp_path}/state"
    tables.write_state(df, out, 1)
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_state(df, out, 1)
    with pytest.raises(Exception, match="(?i)not.exist|PATH_NOT_FOUND"):
        tables.read_state(spark, out, 2).collect()


def test_entry_without_manifest_fails(spark):
    index = spark.createDataFrame([("a", "committed", "m1"), ("b", "deleted", None), ("c", "committed", "m2")], "rel_path string, state string, manifest_key string")
    keys = spark.createDataFrame([("m1",)], "manifest_key string")
    assert [r.rel_path for r in cas.visible_entries(index.where("rel_path <> 'c'"), keys).collect()] == ["a"]
    with pytest.raises(Exception, match="missing manifest: c"):
        cas.visible_entries(index, keys).collect()


DECISIONS = {
    "deny": "config/auth.json .env.local .envrc runner.env.j2 prod.env logs_2.sqlite-wal node_modules node_modules/pkg/index.js .claude/worktrees/agent-a/README.md .claude/backups/x .codex/tmp/arg0/prompt nix/secrets/k .venv/x .direnv/e a/.git/config x/.cache/t .tmp/x",
    "snapshot": "logs_2.sqlite",
    "allow": "sessions/demo.jsonl src/main.rs nix/secretsx secrets/nix Cache/x envrc my.envx",
}


@pytest.mark.parametrize("decision", DECISIONS)
def test_inventory_rules(spark, decision):
    names = DECISIONS[decision].split()
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [(r.p, r.d) for r in df.select("p", ingress.inventory_decision(F.col("p"), F.lit(False))["decision"].alias("d")).collect()] == [(n, decision) for n in names]


def test_eviction_forms_agree(spark):
    rng = random.Random(3)
    rows = [(f"k{i}", rng.randint(0, 50), rng.randint(0, 40)) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, size bigint, mtime bigint")
    total, gone = sum(r[1] for r in rows), set()
    left = total
    for key, size, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if left <= 2000:
            break
        gone.add(key)
        left -= size
    assert {r.key for r in lifecycle.evict(df, 2000).collect()} == gone
    assert {r.key for r in lifecycle.evict(df.withColumn("g", F.lit(1)), 2000, group="g").collect()} == gone
    assert {r.key for r in lifecycle.evict(df, 2000, ranges=7).collect()} == gone
    assert lifecycle.evict(df.limit(0), 2000).count() == 0
    tied = df.withColumn("mtime", F.lit(1).cast("bigint"))  # one time for all: ranges go by key
    left, gone = total, set()
    for key, size, _ in sorted(rows):
        if left <= 2000:
            break
        gone.add(key)
        left -= size
    assert {r.key for r in lifecycle.evict(tied, 2000, ranges=5).collect()} == gone
    two = df.withColumn("g", F.when(F.col("mtime") < 20, "a"))
    assert {r.key for r in lifecycle.evict(two, 500, group="g", ranges=6).collect()} == {r.key for r in lifecycle.evict(two, 500, group="g", ranges=1).collect()} != set()


def test_ancestry_and_policies(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "a")], "child string, parent string")
    pairs = spark.createDataFrame([("c", "a"), ("a", "c"), ("c", "x"), ("c", "c"), ("zz", "a")], "local string, remote string")
    got = {(r.local, r.remote): r.direction for r in trees.ancestry(edges, pairs).collect()}
    assert got == {("c", "a"): "local_ahead", ("a", "c"): "remote_ahead", ("c", "x"): "neither", ("c", "c"): "neither", ("zz", "a"): "neither"}
    files = spark.createDataFrame([("a/b/c",), ("ab/c",), ("a",)], "path string")
    policy = spark.createDataFrame([("a", "always", 5), ("a/b", "on_demand", None)], "folder string, sync_mode string, download_threshold bigint")
    got = {r.path: (r.sync_mode, r.download_threshold) for r in namespace.nearest_policy(files, policy).collect()}
    assert got == {"a/b/c": ("on_demand", None), "ab/c": (None, None), "a": ("always", 5)}
    far = namespace.nearest_policy(files, policy, broadcast_rows=10**9)
    assert {r.path: (r.sync_mode, r.download_threshold) for r in far.collect()} == got


def test_ancestry_of_long_histories(spark):
    """A line of 300 commits with a merge of a side line, beyond any fixed number of generations."""
    edges = [(f"c{i}", f"c{i - 1}") for i in range(1, 300)] + [(f"s{i}", f"s{i - 1}") for i in range(1, 100)] + [("s0", "c50"), ("c250", "s99")]
    pairs = [("c299", "c0"), ("c0", "c299"), ("c299", "s0"), ("s99", "c51"), ("s99", "c50"), ("c249", "s5"), ("c65", "c0"), ("c64", "c0"), ("c7", "c7")]
    got = {(r.local, r.remote): r.direction for r in trees.ancestry(spark.createDataFrame(edges, "child string, parent string"), spark.createDataFrame(pairs, "local string, remote string")).collect()}
    assert got == {p: d for p, d in zip(pairs, ["local_ahead", "remote_ahead", "local_ahead", "neither", "local_ahead", "neither", "local_ahead", "local_ahead", "neither"], strict=True)}


REGISTRY = "device_id string, name string, public_key string, placeholder boolean, revoked boolean, sequence bigint, position bigint, description string"


def test_registry_merge_rules(spark):
    """A placeholder takes the incoming row whole and then refuses a second key; ids fill; names and keys stay."""
    a = spark.createDataFrame([("1", "laptop", "", True, True, 9, 0, "mine"), ("2", "n", "k2", False, True, 5, 1, None), ("", "desk", "k3", False, False, 1, 2, "")], REGISTRY)
    b = spark.createDataFrame([("1", "laptop", "age1k", False, False, 2, 0, None), ("2", "other name", "k2", False, False, 7, 1, "filled"), ("9", "desk", "k3", False, False, 1, 2, "new"), ("9", "new name", "", True, True, 0, 3, None), ("5", "", "k5", False, False, None, 4, None), (None, None, "", True, False, 3, 5, None)], REGISTRY)
    rows = {r.name: r for r in devices.merge_registry(a, b).collect()}
    assert tuple(rows["laptop"])[:6] == ("1", "laptop", "age1k", False, False, 2) and rows["laptop"].description is None and rows["laptop"].changed
    assert tuple(rows["n"])[:6] == ("2", "n", "k2", False, True, 7) and rows["n"].description == "filled"
    assert tuple(rows["desk"])[:6] == ("9", "desk", "k3", False, True, 1) and rows["desk"].description == "new"
    assert rows[""].added and rows[""].sequence == 3 and len(rows) == 4
    second = spark.createDataFrame([("2", "laptop", "age1z", False, False, 1, 7, None)], REGISTRY)
    clashing = b.unionByName(second)
    assert {r.name: r.refused for r in devices.merge_registry(a, clashing, strict=False).collect() if r.refused} == {"laptop": 1}
    with pytest.raises(Exception, match="two real keys differ for device laptop"):
        devices.merge_registry(a, clashing).collect()
    assert devices.merge_registry(a.limit(0), b.limit(0)).collect() == []
    twice = devices.merge_registry(a, b).drop("added", "changed")
    assert not any(r.changed or r.added for r in devices.merge_registry(twice, b.where("name <> ''")).collect())


def test_purge_and_session_rules(spark):
    rows = [("/tmpfoo/a", "p/x", False), ("/private/tmp/a", "p/x", False), ("/tmp/a", "p/x", False), ("/tmp/b", "p/x", True), ("a", "px/y", True)]
    state = spark.createDataFrame([(*r, None) for r in rows], "path string, remote_path string, on_disk boolean, conflict string")
    assert {r.path for r in lifecycle.stale(state, "p//").collect()} == {"/private/tmp/a", "/tmp/a", "a"}
    sessions = spark.createDataFrame([(None, False), (500, False), (501, False), (499, False), (None, True)], "expires_at long, revoked boolean").withColumn("prefixes", F.array().cast("array<string>"))
    assert sorted(str(r.expires_at) for r in lifecycle.live_sessions(sessions, 500).collect()) == ["500", "501", "None"]


def test_entry_without_llm():
    """The library works without the training-data subpackage; nothing outside imports it."""
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "tidemark"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "tidemark.llm" not in f.read_text(), f


def test_entry_without_what_the_operators_import(tmp_path):
    """A missing dependency of the training-data operators leaves them out, and nothing else."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['zstandard'] = sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert 'reconcile_plan' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, check=True)


def test_hex_and_snapshots_fail_on_bad_input(spark):
    assert bytes(spark.range(1).select(cas.from_hex(F.lit("00fF"))).first()[0]) == b"\x00\xff"
    for bad in ("0", "zz", "00 ", "00\n"):
        with pytest.raises(Exception, match="not hex"):
            spark.range(1).select(cas.from_hex(F.lit(bad))).collect()
    for clash in (["a/x", "A/y"], ["a", "a/b"]):
        entries = spark.createDataFrame([(f"s/index/{n}", "manifest_hash=m") for n in clash], "key string, content string")
        with pytest.raises(Exception, match="names clash"):
            tables.namespace_snapshot(entries, "s").collect()


def test_clear_deletes_what_was_written_on_the_way(spark):
    from tidemark.operators import checkpoints

    where = checkpoints.work_folder(spark, "test")
    spark.range(3).write.parquet(where)
    assert spark.read.parquet(where).count() == 3 and checkpoints.clear(spark) and not checkpoints.clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(where)


def test_ancestry_with_merges(spark):
    """Random histories with merges against plain reachability, with and without generation numbers."""
    import functools
    import random

    r = random.Random(7)
    edges = [(f"c{i:03d}", f"c{p:03d}") for i in range(1, 50) for p in r.sample(range(max(0, i - 9), i), min(i, r.choice([0, 1, 1, 2, 3])))]
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)

    @functools.cache
    def above(v):
        return frozenset().union(*({p} | above(p) for p in up.get(v, ())))

    @functools.cache
    def generation(v):
        return 1 + max((generation(p) for p in up.get(v, ())), default=0)

    pairs = list({(f"c{r.randrange(50):03d}", f"c{r.randrange(50):03d}") for _ in range(300)}) + [("zz", "c001"), (None, "c001"), ("c001", None)]
    want = {(a, b): "local_ahead" if a != b and b in above(a) else "remote_ahead" if a != b and a in above(b) else "neither" for a, b in pairs}
    asked = spark.createDataFrame(pairs, "local string, remote string")
    plain = spark.createDataFrame(edges + edges[:3] + [(None, "c001"), ("c001", None), ("c002", "c002")], "child string, parent string")
    numbered = spark.createDataFrame([(c, p, generation(c)) for c, p in edges], "child string, parent string, generation long")
    for given in (plain, numbered):
        assert {(x.local, x.remote): x.direction for x in trees.ancestry(given, asked).collect()} == want
    with pytest.raises(ValueError, match="cycle"):
        trees.ancestry(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"), asked)


def test_ancestry_of_a_long_chain(spark):
    """20,000 commits, each against its parent: no closure, so rows stay as many as commits."""
    n = 20_000
    edges = spark.range(1, n).selectExpr("concat('c', id) child", "concat('c', id - 1) parent")
    pairs = spark.range(1, n).selectExpr("concat('c', id) local", "concat('c', id - 1) remote")
    assert {r.direction: r["count"] for r in trees.ancestry(edges, pairs).groupBy("direction").count().collect()} == {"local_ahead": n - 1}


def test_interval_cells_cover_exactly(spark):
    spans = [(0, 0), (0, 7), (3, 12), (5, 5), (1, 1023), (512, 1022)]
    rows = spark.createDataFrame(spans, "low long, high long").select("low", "high", trees.cells_of(F.col("low"), F.col("high"), 10).alias("cells"))
    for r in rows.collect():
        covered = sorted(x for c in r.cells for x in range(c.block << c.level, (c.block + 1) << c.level))
        assert covered == list(range(r.low, r.high + 1))
        if r.high == 12:
            held = {(c.level, c.block) for c in r.cells}
            assert all(len(held & {(j, x >> j) for j in range(11)}) == (r.low <= x <= r.high) for x in range(20))


def odd_paths(n=400):
    import random

    r = random.Random(11)
    names = ["a", "b", "ab", "a.b", "A", "a\x01", "é", "日", ".", "a b", "-"]
    return sorted({"/".join(r.choice(names) for _ in range(r.randint(1, 6))) for _ in range(n)})


def test_folder_questions_by_order(spark):
    """Over many parts, with names that sort around the separator: below, claims and nearest marks against plain prefixes."""
    from tidemark.operators import folders

    paths_ = odd_paths()
    live = set(paths_[::3])
    rows = spark.createDataFrame([(p, p in live) for p in paths_], "path string, live boolean").repartition(7)
    below = {r.path: r.has_below for r in folders.with_below(rows, F.col("live")).collect()}
    assert below == {p: any(q.startswith(f"{p}/") for q in live) for p in paths_}
    claims = [(r.claim, r.folded) for r in folders.folder_claims(rows, F.lower("path")).collect()]
    want = {"/".join(p.split("/")[:i]) for p in paths_ for i in range(1, p.count("/") + 1)}
    assert sorted(claims) == sorted((c, c.lower()) for c in want)
    marks = {p: i for i, p in enumerate(paths_[::9])}
    given = spark.createDataFrame([(p, i) for p, i in marks.items()] + [(None, -1)], "folder string, n int")
    found = {r.path: r.mark.n for r in folders.nearest_above(rows, given).collect()}
    nearest = {p: next((marks[a] for a in ["/".join(p.split("/")[:i]) for i in range(p.count("/") + 1, 0, -1)] if a in marks), None) for p in paths_}
    assert found == {p: n for p, n in nearest.items() if n is not None}
    assert folders.nearest_above(rows.limit(0), given).collect() == [] and folders.nearest_above(rows, given.limit(0)).collect() == []


def test_folder_plans_multiply_no_path(spark):
    """Beyond the broadcast bound no plan explodes ancestors; attributes of null, repeated and root paths are defined."""
    rows = spark.createDataFrame([("a/b/c", "live"), ("a/x", "deleted"), ("d", "live"), ("d/e", "live")], "path string, state string")
    wanted = spark.createDataFrame([("a",), ("a/b",), ("a/b/c",), ("a/x",), ("",), (None,), ("d",), ("d",), ("zz",)], "path string")
    got = sorted((str(r.path), r.kind) for r in namespace.get_attributes(wanted, rows).collect())
    assert got == sorted([("a", "directory"), ("a/b", "directory"), ("a/b/c", "file"), ("a/x", "not_found"), ("", "directory"), ("None", "not_found"), ("d", "file"), ("d", "file"), ("zz", "not_found")])
    policy = spark.createDataFrame([("a", "always", 5)], "folder string, sync_mode string, download_threshold bigint")
    for df in (namespace.get_attributes(wanted, rows), namespace.ancestor_collisions(rows), namespace.nearest_policy(rows, policy, broadcast_rows=10**9), lifecycle.removable_directories(rows, wanted)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Python" not in plan and "Arrow" not in plan


def test_hot_keys_are_scanned_by_segments(spark, monkeypatch):
    """One path with nearly all events and frames; segments of a few rows give what one scan gives."""
    import random

    from tidemark.operators import scans

    monkeypatch.setattr(scans, "SEGMENT_ROWS", 16)
    r = random.Random(2)
    rows, t = [], 0
    for i in range(900):
        t += r.choice([0, 0, 1, 30, 99, 100, 101, 2500])
        rows.append(("hot", t, i, r.choice("abc")))
    rows += [("cold", 5, 1000, "a"), (None, 5, 1001, "a"), ("hot", None, 1002, "z"), ("neg", -70, 1, "a"), ("neg", 29, 2, "b"), ("neg", 130, 3, "c")]
    want, last = [], {}
    for path, ts, seq, kind in sorted((x for x in rows if x[0] and x[1] is not None), key=lambda x: x[1:3]):
        if path in last and ts - last[path][2] < 100:
            last[path][2:] = [ts, last[path][3] + 1, kind]
        else:
            last[path] = [path, ts, ts, 1, kind]
            want.append(last[path])
    events = spark.createDataFrame(rows, "path string, ts_micros long, seq long, kind string")
    assert scans.segment_width(events, "ts_micros", 16) > 0
    numbered = scans.numbered_periods(events.where("path IS NOT NULL AND ts_micros IS NOT NULL"), "path", "ts_micros", ["ts_micros", "seq"], 100, 150)
    found = numbered.groupBy("path", "period").agg(F.min("ts_micros"), F.max("ts_micros"), F.count("*"), F.max_by("kind", F.struct("ts_micros", "seq"))).drop("period")
    assert sorted(map(list, found.collect())) == sorted(map(list, ev.debounce(events, 100).collect())) == sorted(want)
    frames = spark.createDataFrame([("f", i, i % 5, 1) for i in range(300)] + [(None, 3, 7, 2), (None, 40, 1, 2), ("g", 0, 9, 9)], "path string, pos int, uncompressed long, compressed long")
    sums = {(x.path, x.pos): (x.a, x.b) for x in scans.prefix_sums(frames, "path", "pos", {"a": "uncompressed", "b": "compressed"}, 16).collect()}
    assert sums == {("f", i): (sum(j % 5 for j in range(i)), i) for i in range(300)} | {(None, 3): (0, 0), (None, 40): (7, 2), ("g", 0): (0, 0)}


def test_admission_follows_the_order(spark, tmp_path):
    """A refused path claims nothing, so the one that contradicts only it is admitted."""
    out = f"file://{tmp_path}/claims"
    namespace.write_claims(spark.createDataFrame([("Docs/a.txt",), ("b",)], "path string"), out)
    asked = [("docs/new", 1, "spelling_collision"), ("Docs/new", 2, "admitted"), ("b/c", 3, "role_collision"), ("B", 4, "spelling_collision"), ("x/y", 5, "admitted"), ("X", 6, "spelling_collision"), ("x", 7, "role_collision"), ("Docs/a.txt", 8, "admitted"), ("P", 9, "admitted"), ("p/q", 10, "spelling_collision"), ("p/Q/r", 11, "spelling_collision"), ("Docs/NEW/z", 12, "spelling_collision"), ("docs2/Q", 13, "admitted"), ("docs2/q", 14, "spelling_collision"), ("docs2/Q", 15, "admitted")]
    batch = spark.createDataFrame([x[:2] for x in asked] + [(None, 99)], "path string, seq long")
    held = spark.read.parquet(out)
    assert sorted((r.path, r.seq, r.outcome) for r in namespace.admit(held, batch).collect()) == sorted(asked)
    chain = spark.createDataFrame([("C/a", 1), ("c/b", 2), ("c/b/x", 3), ("D", 4)], "path string, seq long")
    assert {r.seq: r.outcome for r in namespace.admit(held, chain).collect()} == {1: "admitted", 2: "spelling_collision", 3: "spelling_collision", 4: "admitted"}
    assert namespace.admit(held, batch.limit(0)).collect() == []


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    """Other buckets keep their files, a stale base fails, and a repeated upsert changes nothing."""
    out, where = f"file://{tmp_path}/index", tmp_path / "index"
    rows = spark.range(200).selectExpr("concat('p', id) rel_path", "id value", "1L seq")
    tables.create_index(rows, out, buckets=8)
    files = lambda: {d.name: sorted(f.name for f in d.glob("*.parquet")) for d in where.glob("bucket=*")}
    before = files()
    change = spark.createDataFrame([("p7", 70, 2), ("new", 1, 2)], "rel_path string, value long, seq long")
    assert tables.upsert_index(out, change, 0) == 1
    after = files()
    touched = {r.bucket for r in spark.read.parquet(out).where("rel_path IN ('p7', 'new')").select("bucket").collect()}
    assert {b for b in before if before[b] != after.get(b)} == {f"bucket={b}" for b in touched} and len(touched) < len(before)
    with pytest.raises(RuntimeError, match="stale base"):
        tables.upsert_index(out, change, 0)
    assert tables.upsert_index(out, change, 1) == 2 and tables.index_version(spark, out) == (2, 8)
    got = {r.rel_path: r.value for r in spark.read.parquet(out).collect()}
    assert got == {f"p{i}": i for i in range(200)} | {"p7": 70, "new": 1} and spark.read.parquet(out).count() == 201


def test_hydrate_names_the_first_fault(spark):
    import hashlib

    sha = lambda b: hashlib.sha256(b).hexdigest()
    store = [(sha(b"ab"), b"ab"), (sha(b"cd"), b"cX"), (sha(b"ef"), b"ef")]
    ab, cd, ef, no = sha(b"ab"), sha(b"cd"), sha(b"ef"), sha(b"no")
    files = [("ok", [ab, ef, ab], 6, sha(b"abefab"), (6, None, None)), ("empty", [], 0, sha(b""), (0, None, None)), ("short", [], 3, sha(b""), (0, "size", None)), ("bad", [ab, cd, no], 6, "x", (2, "chunk", 1)), ("gone", [ab, no, cd], 6, "x", (2, "missing", 1)), ("over", [ab, ef, ef], 3, "x", (2, "overrun", 1)), ("hash", [ab], 2, "x", (2, "hash", None)), ("old", [ab, ef], 0, None, (4, None, None)), ("oldbad", [cd], 0, None, (0, "chunk", 0))]
    rows = spark.createDataFrame([f[:4] for f in files], "path string, chunks array<string>, file_size long, file_hash string")
    found = {r.path: (r.n_bytes, r.fault, r.at) for r in cas.hydrate(rows.repartition(3), spark.createDataFrame(store, "hash string, chunk binary")).collect()}
    assert found == {f[0]: f[4] for f in files}
    assert cas.hydrate(rows.limit(0), spark.createDataFrame(store, "hash string, chunk binary")).collect() == []


def test_requests_meet_their_frames_once(spark):
    import random

    r = random.Random(6)
    frames, at = [], {}
    for i in range(120):
        p = r.choice("ab")
        n = r.choice([0, 1, 7, 30, 64])
        frames.append((p, i, at.get(p, 0), n))
        at[p] = at.get(p, 0) + n
    asked = [(r.choice("abz"), s := r.randint(-20, 2500), r.choice([None, s, s - 5, s + 1, s + 400, 1 << 40]), i) for i in range(80)]
    want = sorted((i, pos) for p, s, e, i in asked for q, pos, b, n in frames if p == q and n and max(s, 0) < (at[p] if e is None else min(e, at[p])) and b < (at[p] if e is None else e) and b + n > max(s, 0))
    got = cas.requested_frames(spark.createDataFrame(frames, "path string, pos int, begin long, uncompressed long"), spark.createDataFrame(asked, "path string, start long, end long, id int"))
    assert sorted((x.id, x.pos) for x in got.collect()) == want and want


def test_chunker_as_a_table_function(spark):
    """The same boundaries as whole contents give, whatever the blocks; empty and null blocks, and two files in one task."""
    import random

    r = random.Random(8)
    bodies = {p: bytes(r.randrange(256) for _ in range(n)) for p, n in (("a", 60_000), ("b", 1), ("c", 0), ("d", 9000))}
    whole = spark.createDataFrame([(p, b, "small") for p, b in bodies.items()], "path string, content binary, profile string")
    blocks = [(p, i // 1700, b[i : i + 1700], None) for p, b in bodies.items() for i in range(0, max(len(b), 1), 1700)] + [("a", 10_000, None, None)]
    cas.register_chunker(spark)
    spark.createDataFrame(blocks, "path string, block int, content binary, profile string").createOrReplaceTempView("test_blocks")
    found = spark.sql("SELECT * FROM block_chunks(TABLE(test_blocks) PARTITION BY path ORDER BY block)").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, cas.content_chunks(whole).collect())) and len(found) > 10


def test_first_fault_of_a_path(spark):
    """Of two faults the earlier test names the path: decomposed letters count before bad components."""
    given = [("../e\u0301", "not_nfc"), ("/e\u0301", "not_relative"), ("a/./b", "dot_component"), ("e\u0301.", "not_nfc"), ("\u00e9/b", None)]
    rows = spark.createDataFrame(given, "path string, fault string")
    assert all(r.fault == r.found for r in rows.withColumn("found", paths.canonical_fault(F.col("path"))).collect())


def walked_in_order(rows):
    """A depth-first walk of a listing in the order of its names that follows links, with a set of real folders met."""
    kind, target = {p: k for p, k, _ in rows}, {p: t for p, _, t in rows}

    def real(path, depth=0):
        parts = path.split("/")
        for i in range(1, len(parts) + 1):
            head = "/".join(parts[:i])
            if kind.get(head) == "symlink":
                return None if depth > 60 else real("/".join([target[head], *parts[i:]]), depth + 1)
        return path if path in kind else None

    out, seen = [], set()

    def walk(at, folder):
        before = sum(k == "file" for _, k in out)
        inside = sorted((p for p in kind if p.rpartition("/")[0] == folder), key=lambda p: p.rpartition("/")[2].encode())
        for p in inside:
            name = p.rpartition("/")[2]
            shown = f"{at}/{name}" if at else name
            if name.startswith(".") and kind[p] == "directory":
                continue
            if kind[p] == "file":
                out.append((shown, "file"))
                continue
            goal = real(p) if kind[p] == "symlink" else p
            if goal is None or goal in seen:
                continue
            seen.add(goal)
            if kind[goal] == "directory":
                walk(shown, goal)
            else:
                out.append((shown, "file"))
        if sum(k == "file" for _, k in out) == before and at:
            out.append((at, "empty_dir"))

    walk("", "")
    return sorted(out)


def test_walk_follows_links_to_folders(spark):
    """Random listings with links to folders, through links, upwards, in cycles and out of hidden folders, against a plain walk."""
    import random

    r = random.Random(21)
    rows, base = [], []
    for tree in range(6):
        folders = [f"t{tree}"]
        for i in range(8):
            folders.append(f"{r.choice(folders)}/{r.choice(['a', 'm', 'z', '.h', 'q'])}{i}")
        entries = {f: ("directory", None) for f in folders}
        for i in range(6):
            entries[f"{r.choice(folders)}/{r.choice('bky')}f{i}"] = ("file", None)
        files = [p for p, (k, _) in entries.items() if k == "file"]
        links = [f"{r.choice(folders)}/{r.choice('0cw')}l{i}" for i in range(7)]
        for p in links:
            goal = r.choice([*folders, *files, *links, f"{r.choice(links)}/{r.choice(['a', 'm'])}{r.randrange(8)}", "/out/side"])
            entries[p] = ("symlink", goal)
        base += [(p, k, t) for p, (k, t) in entries.items()]
    rows = base
    df = spark.createDataFrame(rows, "rel_path string, kind string, target string")
    assert sorted((x.rel_path, x.kind) for x in tables.walk(df, links="follow").collect()) == walked_in_order(rows)
