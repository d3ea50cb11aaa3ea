"""Content-addressed storage: chunks, manifests, dedup, reassembly, reachability and collection.

H01-H12, J05, J06, J12, J17, L04, L06, L07, L14-L17, A08, A19, S05, V09, V10, W02.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from pyspark.sql.window import Window

from tidemark.operators import scans

#: Least seconds that an unreferenced chunk of an indexed store is kept.
GRACE_FLOOR = 86_400
#: Least, average and most bytes of a chunk, by profile.
PROFILES = {"small": (2 << 10, 4 << 10, 16 << 10), "pack": (32 << 10, 64 << 10, 256 << 10), "large": (1 << 20, 4 << 20, 16 << 20)}


def content_id(value: Column, domain: str = "") -> Column:
    """SHA-256 of a domain and the bytes (the content address of this engine)."""
    data = value.cast("binary")
    return F.sha2(F.concat(F.lit(domain + "\0").cast("binary"), data) if domain else data, 256)


def to_hex(value: Column) -> Column:
    """Bytes as lowercase hex."""
    return F.lower(F.hex(value))


def from_hex(text: Column) -> Column:
    """The bytes of a hex text; anything else is an error."""
    return F.when(text.isNull() | text.rlike(r"^([0-9a-fA-F]{2})*\z"), F.unhex(text)).otherwise(F.raise_error(F.concat(F.lit("not hex: "), text)).cast("binary"))


def fixed_chunks(files: DataFrame, size: int, key: str = "path", content: str = "content") -> DataFrame:
    """(key, pos, offset, length, chunk, hash): content in runs of ``size`` characters; none if empty.

    A content is cut once, so a file costs what its length costs."""
    runs = F.regexp_extract_all(F.coalesce(F.col(content), F.lit("")), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    out = files.select(key, F.posexplode(runs).alias("pos", "chunk"))
    return out.select(key, "pos", (F.col("pos").cast("long") * size).alias("offset"), "chunk", F.length("chunk").cast("long").alias("length"), content_id(F.col("chunk")).alias("hash"))


#: Bytes before a position that its rolling hash covers, itself included; bytes hashed at once.
HASH_SPAN, WINDOW = 32, 1 << 18


@cache
def gear_table(seed: int = 1) -> np.ndarray:
    """256 pseudo-random 32-bit numbers of the rolling hash, from a linear rule."""
    x, out = seed, []
    for _ in range(256):
        x = (x * 6364136223846793005 + 1442695040888963407) & (2**64 - 1)
        out.append((x ^ x >> 33) * 0xFF51AFD7ED558CCD >> 32 & (2**32 - 1))
    return np.array(out, np.uint32)


class Chunker:
    """Content-defined chunks of one file that comes in pieces, with bounded memory.

    A boundary is a byte after which the top bits of the gear hash of the last HASH_SPAN bytes are zero:
    more bits before the average size, fewer after, and none before the least or beyond the most bytes of
    a chunk.  What is held is the open chunk and one piece, and boundaries do not depend on the pieces."""

    def __init__(self, least: int, average: int, most: int):
        self.sizes = least, average, most
        bits = average.bit_length() - 1
        self.strict_below, self.loose_below = np.uint32(1 << (31 - bits)), np.uint32(1 << (33 - bits))
        self.tail, self.held, self.start = b"", bytearray(), 0  # start: where ``held`` begins in the file
        self.strict, self.loose = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _mark(self, piece: memoryview) -> None:
        """Candidate boundaries of the next piece, by position in the file."""
        at = self.start + len(self.held)
        before = len(self.tail)
        h = gear_table()[np.frombuffer(self.tail + bytes(piece), np.uint8)]
        span = 1
        while span < HASH_SPAN:  # h[i] = sum of table[byte i - k] << k over the last HASH_SPAN bytes, by doubling
            h[span:] += h[:-span] << np.uint32(span)
            span *= 2
        loose = np.flatnonzero(h[before:] < self.loose_below)
        strict = loose[h[before:][loose] < self.strict_below]
        self.loose, self.strict = np.concatenate((self.loose, loose + at)), np.concatenate((self.strict, strict + at))
        self.tail = (self.tail + bytes(piece[-HASH_SPAN:]))[-(HASH_SPAN - 1) :]

    def _cut(self, end: int) -> memoryview:
        """The open chunk up to a position."""
        chunk = bytes(self.held[: end - self.start])
        del self.held[: end - self.start]
        self.start = end
        self.strict, self.loose = self.strict[np.searchsorted(self.strict, end) :], self.loose[np.searchsorted(self.loose, end) :]
        return chunk

    def _boundary(self, n: int) -> int:
        """The end of the open chunk, of a file that has n bytes at least."""
        least, average, most = self.sizes
        middle, limit = min(self.start + average, n), min(self.start + most, n)
        i = np.searchsorted(self.strict, self.start + least)
        if i < len(self.strict) and self.strict[i] < middle:
            return int(self.strict[i]) + 1
        i = np.searchsorted(self.loose, max(middle, self.start + least))
        return int(self.loose[i]) + 1 if i < len(self.loose) and self.loose[i] < limit else limit

    def feed(self, data: bytes) -> Iterator[bytes]:
        """Chunks that end for certain within what has come so far."""
        for begin in range(0, len(data), WINDOW):
            piece = memoryview(data)[begin : begin + WINDOW]
            self._mark(piece)
            self.held += piece
            while len(self.held) >= self.sizes[2]:
                yield self._cut(self._boundary(self.start + len(self.held)))

    def finish(self) -> Iterator[bytes]:
        """The chunks that are left at the end of the file."""
        n = self.start + len(self.held)
        while n - self.start > self.sizes[0]:
            yield self._cut(self._boundary(n))
        if self.held:
            yield self._cut(n)


def cut_points(data: bytes, least: int, average: int, most: int) -> list[int]:
    """Ends of the chunks of one file.  Deterministic; they cover the input; none for empty input."""
    chunker, ends = Chunker(least, average, most), [0]
    for chunk in chain(chunker.feed(data), chunker.finish()):
        ends.append(ends[-1] + len(chunk))
    return ends[1:]


_CHUNK_ROWS = "k string, pos int, offset long, length long, hash string"


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k", "pos", "offset", "length", "hash"])


def content_chunks(files: DataFrame, key: str = "path", content: str = "content", profile: str = "profile") -> DataFrame:
    """(key, pos, offset, length, hash) of each file (bytes or text) under its row's profile.
    Only lengths and hashes leave the tasks; null and empty contents have no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, data, size in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                start, chunker, body = 0, Chunker(*PROFILES[size or "small"]), data.as_buffer() if data.is_valid else b""
                for pos, chunk in enumerate(chain(chunker.feed(body), chunker.finish())):
                    rows.append((k, pos, start, len(chunk), hashlib.sha256(chunk).hexdigest()))
                    start += len(chunk)
            yield _chunk_batch(rows)

    given = files.select(F.col(key).cast("string").alias("k"), F.col(content).cast("binary").alias("c"), F.col(profile).alias("p"))
    return given.mapInArrow(run, _CHUNK_ROWS).withColumnRenamed("k", key)


def block_chunks(blocks: DataFrame, key: str = "path", block: str = "block", content: str = "content", profile: str = "profile") -> DataFrame:
    """``content_chunks`` of files that come as rows of consecutive blocks, for files of any size: a task
    holds a batch of blocks and the open chunk of one file.  Null blocks count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker, now, pos, at = None, None, 0, 0

        def taken(chunks: Iterator[bytes]) -> list[tuple]:
            nonlocal pos, at
            rows = []
            for chunk in chunks:
                rows.append((now, pos, at, len(chunk), hashlib.sha256(chunk).hexdigest()))
                pos, at = pos + 1, at + len(chunk)
            return rows

        for batch in batches:
            rows = []
            for k, data, size in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if chunker is None or k != now:
                    rows += taken(chunker.finish()) if chunker is not None else []
                    chunker, now, pos, at = Chunker(*PROFILES[size or "small"]), k, 0, 0
                rows += taken(chunker.feed(data.as_buffer() if data.is_valid else b""))
            yield _chunk_batch(rows)
        if chunker is not None:
            yield _chunk_batch(taken(chunker.finish()))

    given = blocks.select(F.col(key).cast("string").alias("k"), F.col(block).alias("b"), F.col(content).cast("binary").alias("c"), F.col(profile).alias("p"))
    return given.repartition("k").sortWithinPartitions("k", "b").mapInArrow(run, _CHUNK_ROWS).withColumnRenamed("k", key)


def register_chunker(spark: SparkSession, name: str = "block_chunks") -> None:
    """H04 for SQL: a table function that cuts the blocks of each file, of any size, as ``block_chunks`` does:

    SELECT * FROM block_chunks(TABLE(SELECT path, block, content, profile FROM blocks) PARTITION BY path ORDER BY block)

    Spark deals a file's blocks to one call in their order; the call holds one block and the open chunk.  Files are apart, null blocks
    count as empty, and a null profile means ``small``."""
    from pyspark.sql.functions import udtf

    class BlockChunks:
        def __init__(self):
            self.chunker, self.path, self.pos, self.at = None, None, 0, 0

        def _rows(self, chunks: Iterator[bytes]) -> Iterator[tuple]:
            for chunk in chunks:
                yield self.path, self.pos, self.at, len(chunk), hashlib.sha256(chunk).hexdigest()
                self.pos, self.at = self.pos + 1, self.at + len(chunk)

        def eval(self, row):
            if self.chunker is None:
                self.chunker, self.path = Chunker(*PROFILES[row["profile"] or "small"]), row["path"]
            content = row["content"]
            yield from self._rows(self.chunker.feed(content.encode() if isinstance(content, str) else bytes(content or b"")))

        def terminate(self):
            if self.chunker is not None:
                yield from self._rows(self.chunker.finish())

    spark.udtf.register(name, udtf(BlockChunks, returnType="path string, pos int, offset long, length long, hash string"))


def manifests(chunks: DataFrame, key: str = "path") -> DataFrame:
    """One row a file: chunk hashes in order, size (A19) and the manifest's id."""
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("_c"), F.sum("length").cast("long").alias("file_size"))
    hashes = F.transform("_c", lambda c: c["hash"])
    return rows.select(key, hashes.alias("chunks"), F.size("_c").cast("long").alias("n_chunks"), "file_size", content_id(F.array_join(hashes, "\n"), "manifest-object-v1").alias("manifest_id"))


def dedup_report(chunks: DataFrame) -> DataFrame:
    """One row: chunks, distinct chunks, bytes and bytes stored once."""
    each = chunks.groupBy("hash").agg(F.count("*").alias("n"), F.max("length").alias("length"))
    return each.agg(F.sum("n").cast("long").alias("n_chunks"), F.count("*").cast("long").alias("n_distinct"), F.sum(F.col("n") * F.col("length")).cast("long").alias("total_length"), F.sum("length").cast("long").alias("stored_length"))


def reassemble(manifest_rows: DataFrame, store: DataFrame, key: str = "path") -> DataFrame:
    """Content from the ordered chunk hashes; (key, content, missing).  store: (hash, chunk)."""
    each = manifest_rows.select(key, F.posexplode("chunks").alias("pos", "hash"))
    joined = each.join(store.select("hash", "chunk"), "hash", "left")
    parts = F.array_sort(F.collect_list(F.struct("pos", "chunk")))
    return joined.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["chunk"]), "").alias("content"), F.count_if(F.col("chunk").isNull()).alias("missing"))


def integrity(assembled: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """Size and hash of reassembled content against (key, file_size, file_hash)."""
    return assembled.join(expected, key, "left").select(key, ((F.length("content") == F.col("file_size")) & (F.col("missing") == 0)).alias("size_ok"), (content_id(F.col("content")) == F.col("file_hash")).alias("hash_ok"))


def hydrate(manifest_rows: DataFrame, store: DataFrame, key: str = "path") -> DataFrame:
    """(key, n_bytes, sha256, fault, at) of files read chunk by chunk, none held whole.

    manifest_rows: (key, chunks, file_size, file_hash), store: (hash, chunk), one row a hash.  Chunks come sorted and are
    checked as they come: one that is absent (``missing``) or is not what its hash says (``chunk``), or that takes
    the file beyond its declared size (``overrun``), ends the file at that chunk; n_bytes and sha256 cover what came before
    it.  At the end the whole size and hash count (``size``, ``hash``; at is null); a null file_hash leaves both out, as
    for manifests that declare none.  A file without chunks is empty.  Rows that repeat a key are one file."""
    each = manifest_rows.select(F.col(key).cast("string").alias("k"), F.posexplode("chunks").alias("pos", "hash")).join(store.select("hash", F.col("chunk").cast("binary").alias("chunk")), "hash", "left")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    body = each.select("k", "pos", "hash", "chunk", none("file_size", "long"), none("file_hash", "string"))
    head = manifest_rows.select(F.col(key).cast("string").alias("k"), F.lit(-1).alias("pos"), none("hash", "string"), none("chunk", "binary"), F.col("file_size").cast("long").alias("file_size"), "file_hash")
    kinds = pa.schema([("k", pa.string()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("fault", pa.string()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def done(f: dict) -> dict:
            found = f["digest"].hexdigest()
            if f["fault"] is None and f["file_hash"] is not None:
                f["fault"] = "size" if f["n_bytes"] != f["file_size"] else "hash" if found != f["file_hash"] else None
            return {"k": f["k"], "n_bytes": f["n_bytes"], "sha256": found, "fault": f["fault"], "at": f["at"]}

        for batch in batches:
            out = []
            k, pos, hashes, chunks, sizes, wanted = batch.columns
            for i in range(batch.num_rows):
                name = k[i].as_py()
                if held is None or name != held["k"]:
                    if held is not None:
                        out.append(done(held))
                    held = {"k": name, "n_bytes": 0, "digest": hashlib.sha256(), "fault": None, "at": None, "file_size": None, "file_hash": None, "last": -1}
                at = pos[i].as_py()
                if at < 0:
                    held["file_size"], held["file_hash"] = sizes[i].as_py(), wanted[i].as_py()
                    continue
                if held["fault"] is not None or at == held["last"]:
                    continue
                held["last"] = at
                chunk = chunks[i].as_buffer() if chunks[i].is_valid else None
                if chunk is None:
                    fault = "missing"
                elif hashlib.sha256(chunk).hexdigest() != hashes[i].as_py():
                    fault = "chunk"
                elif held["file_hash"] is not None and held["file_size"] is not None and held["n_bytes"] + chunk.size > held["file_size"]:
                    fault = "overrun"
                else:
                    held["digest"].update(chunk)
                    held["n_bytes"] += chunk.size
                    continue
                held["fault"], held["at"] = fault, at
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
        if held is not None:
            yield pa.RecordBatch.from_pylist([done(held)], kinds)

    sorted_rows = head.unionByName(body).repartition("k").sortWithinPartitions("k", "pos").select("k", "pos", "hash", "chunk", "file_size", "file_hash")
    return sorted_rows.mapInArrow(run, "k string, n_bytes long, sha256 string, fault string, at long").withColumnRenamed("k", key)


def reachable(*sources: DataFrame) -> DataFrame:
    """Distinct hashes of sources that have ``chunks`` (arrays) or ``hash``."""
    found = [s.select(F.explode("chunks").alias("hash")) if "chunks" in s.columns else s.select("hash") for s in sources]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out.distinct()


def orphans(chunk_objects: DataFrame, referenced: DataFrame) -> DataFrame:
    """Stored chunks that nothing refers to."""
    return chunk_objects.join(referenced, "hash", "left_anti")


def orphan_report(chunk_objects: DataFrame, referenced: DataFrame) -> DataFrame:
    """One row of counts."""
    marked = chunk_objects.join(referenced.withColumn("_used", F.lit(True)), "hash", "left")
    return marked.agg(F.count("*").alias("scanned"), F.count_if("_used").alias("referenced"), F.count_if(F.col("_used").isNull()).alias("orphaned"))


def grace(requested: int, indexed: bool = True) -> int:
    """Indexed stores keep orphans a day at least; the older layout honours any value."""
    return max(requested, GRACE_FLOOR) if indexed else requested


def cleanup_plan(orphan_rows: DataFrame, now: int, grace_seconds: int) -> DataFrame:
    """Orphans (hash, last_modified) with skip / delete / within_grace; future times are young."""
    age = F.lit(now) - F.col("last_modified")
    plan = F.when(F.col("last_modified").isNull(), "skip").when(age >= grace_seconds, "delete").otherwise("within_grace")
    return orphan_rows.withColumn("plan", plan).orderBy("hash")


def delete_readiness(rows: DataFrame, now: int, grace_seconds: int) -> DataFrame:
    """Rows (hash, scanned, fresh, version) re-checked before deletion."""
    ready = F.when(F.col("fresh").isNull(), "already_gone").when(~F.col("fresh").eqNullSafe(F.col("scanned")) | (F.lit(now) - F.col("fresh") < grace_seconds), "within_grace").when(F.col("version").isNull(), "not_deletable").otherwise("ready")
    return rows.withColumn("readiness", ready)


def index_faults(entries: DataFrame) -> DataFrame:
    """Index rows (state, has_current, has_pending, version, kind) that break an invariant."""
    fault = (
        F.when(~F.col("state").isin("committed", "preparing", "deleted"), "unknown_state")
        .when((F.col("state") == "committed") & (~F.col("has_current") | F.col("has_pending")), "committed_needs_current_only")
        .when((F.col("state") == "preparing") & ~F.col("has_pending"), "preparing_needs_pending")
        .when((F.col("state") == "deleted") & (F.col("has_current") | F.col("has_pending")), "deleted_has_entry")
        .when((F.col("version") == 4) != (F.col("state") == "deleted"), "version_4_means_deleted")
        .when((F.col("kind") == "symlink") & (F.col("version") < 3), "symlink_needs_version_3")
    )
    return entries.withColumn("fault", fault)


def inspect_index(wanted: DataFrame, index: DataFrame, manifest_keys: DataFrame) -> DataFrame:
    """Status of each wanted path (rel_path) by its index row (rel_path, state, manifest_key,
    parsed) and the stored manifests (manifest_key)."""
    i = index.select("rel_path", "state", "manifest_key", "parsed", F.lit(True).alias("_row"))
    m = manifest_keys.select("manifest_key", F.lit(True).alias("_stored"))
    joined = wanted.join(i, "rel_path", "left").join(m, "manifest_key", "left")
    status = (
        F.when(F.col("_row").isNull(), "missing_index")
        .when(~F.col("parsed"), "parse_error")
        .when(F.col("state") == "preparing", "preparing_only")
        .when(F.col("state") == "deleted", "no_visible_entry")
        .when(F.col("_stored").isNull(), "missing_manifest")
        .otherwise("visible")
    )
    return joined.select("rel_path", status.alias("status"))


def visible_entries(index: DataFrame, manifest_keys: DataFrame) -> DataFrame:
    """Committed rows (rel_path, state, manifest_key); one without its stored manifest fails the scan."""
    stored = manifest_keys.select("manifest_key", F.lit(True).alias("_stored")).distinct()
    shown = index.where("state = 'committed'").select("rel_path", "manifest_key").join(stored, "manifest_key", "left")
    missing = F.raise_error(F.concat(F.lit("entry points to a missing manifest: "), F.col("rel_path")))
    return shown.select(F.when(F.col("_stored").isNull(), missing).otherwise(F.col("rel_path")).alias("rel_path"), "manifest_key")


def recover_pending(pending: DataFrame, finals: DataFrame, staged: DataFrame) -> DataFrame:
    """Preparing rows (rel_path, manifest_key, staged_key): committed if the final or the staged
    manifest (key, ok) is stored and verified, else an error."""
    f, s = finals.select(F.col("key").alias("manifest_key"), F.col("ok").alias("_f")), staged.select(F.col("key").alias("staged_key"), F.col("ok").alias("_s"))
    joined = pending.join(f, "manifest_key", "left").join(s, "staged_key", "left")
    return joined.select("rel_path", F.when(F.col("_f"), "commit_final").when(F.col("_s"), "commit_staged").otherwise("error").alias("recovery"))


def binding_faults(index: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """Index rows whose manifest disagrees in kind, size, chunk count or path."""
    m = manifest_rows.select("manifest_key", *[F.col(c).alias(f"m_{c}") for c in ("kind", "file_size", "n_chunks", "rel_path")])
    joined = index.join(m, "manifest_key", "left")
    fault = F.when(F.col("m_kind").isNull(), "missing_manifest").when(F.col("kind") != F.col("m_kind"), "kind").when(F.col("file_size") != F.col("m_file_size"), "size").when(F.col("n_chunks") != F.col("m_n_chunks"), "chunks").when(F.col("m_rel_path").isNotNull() & (F.col("m_rel_path") != F.col("rel_path")), "path")
    return joined.select("rel_path", fault.alias("fault"))


def cached_hydrate(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, version, file_hash) against the cache (key, hash): hit, refetch or fetch; version 1 bypasses."""
    joined = wanted.join(cache.select("key", F.col("hash").alias("_held")), "key", "left")
    return joined.select("key", F.when(F.col("version") == 1, "bypass").when(F.col("_held").isNull(), "fetch").when(F.col("_held") == F.col("file_hash"), "hit").otherwise("evict_and_refetch").alias("decision"))


def frame_offsets(frames: DataFrame, key: str = "path") -> DataFrame:
    """Where each frame (key, pos, uncompressed, compressed) begins, in both byte orders; a file's frames are
    summed by runs of positions, so one of any size spreads over tasks."""
    return scans.prefix_sums(frames, key, "pos", {"begin": "uncompressed", "stored_at": "compressed"})


def requested_frames(frames: DataFrame, requests: DataFrame, key: str = "path") -> DataFrame:
    """J17 for many requests: each (key, start, end, ...) with the frames (key, pos, begin, uncompressed) that it touches.

    Offsets are cut into cells as wide as the largest frame, so a frame lies in two of them at most; a request takes the cells up to
    its file's end.  Equal cells meet, the overlap is tested after, and a pair counts in its first common cell.  Empty requests
    and frames meet nothing; a negative start counts from 0, a null end means the file's end."""
    f = frames.where("uncompressed > 0").select(key, "pos", "begin", (F.col("begin") + F.col("uncompressed")).alias("until"))
    widest = frames.agg(F.max("uncompressed")).first()[0] or 1
    cell = 1 << max(0, int(widest) - 1).bit_length()
    ends = f.groupBy(key).agg(F.max("until").alias("_size"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell)))
    r = requests.join(ends, key).withColumns({"_from": F.greatest("start", F.lit(0)), "_to": F.least(F.coalesce("end", "_size"), F.col("_size"))}).where("_from < _to")
    wanted = r.withColumn("_cell", cells("_from", "_to"))
    held = f.withColumn("_cell", cells("begin", "until"))
    first = F.floor(F.greatest("_from", "begin") / cell)
    met = wanted.join(held, [key, "_cell"]).where((F.col("begin") < F.col("_to")) & (F.col("until") > F.col("_from")) & (F.col("_cell") == first))
    return met.select(*requests.columns, "pos", "begin")


def overlapping_frames(frames: DataFrame, start: Column, end: Column, key: str = "path") -> DataFrame:
    """Frames that hold bytes of [start, end)."""
    return frame_offsets(frames, key).where((F.col("begin") < end) & (F.col("begin") + F.col("uncompressed") > start))


#: Bytes of frames, or of what they hold, that a task makes before it hands them on; one larger frame alone exceeds it.
BATCH_BYTES = 4 << 20


def _framed(batches: Iterator[pa.RecordBatch], frame_bytes: int, level: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, content) to frames, handed on every BATCH_BYTES, however many rows a batch has and however long they are."""
    import zstandard

    z = zstandard.ZstdCompressor(level=level)
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["k", "pos", "uncompressed", "compressed", "frame"])

    for batch in batches:
        rows, held = [], 0
        for k, data in zip(batch.column(0), batch.column(1), strict=True):
            body = memoryview(data.as_buffer() if data.is_valid else b"")
            for pos, i in enumerate(range(0, len(body), frame_bytes)):
                piece = body[i : i + frame_bytes]
                frame = z.compress(piece)
                if rows and held + len(frame) > BATCH_BYTES:
                    yield made(rows)
                    rows, held = [], 0
                rows.append((k.as_py(), pos, len(piece), len(frame), frame))
                held += len(frame)
        if rows:
            yield made(rows)


def compress_frames(files: DataFrame, frame_bytes: int = 1 << 20, level: int = 3, key: str = "path", content: str = "content") -> DataFrame:
    """(key, pos, uncompressed, compressed, frame): independent zstandard frames; none if empty."""
    given = files.select(F.col(key).cast("string").alias("k"), F.col(content).cast("binary").alias("c"))
    return given.mapInArrow(lambda batches: _framed(batches, frame_bytes, level), "k string, pos int, uncompressed long, compressed long, frame binary").withColumnRenamed("k", key)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, pos, frame, uncompressed, low, size) to the bytes [low, low + size) of each frame, handed on every BATCH_BYTES."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    for batch in batches:
        sizes = batch.column(3).to_pylist()
        begin, held, parts = 0, 0, []
        for i, (data, low, size) in enumerate(zip(batch.column(2), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
            if parts and held + sizes[i] > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(parts)).columns[:2], pa.array(parts, pa.binary())], names=[*batch.schema.names[:2], "_b"])
                begin, held, parts = i, 0, []
            parts.append(z.decompress(data.as_buffer())[low : low + size] if data.is_valid else None)
            held += sizes[i]
        if parts:
            yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(parts)).columns[:2], pa.array(parts, pa.binary())], names=[*batch.schema.names[:2], "_b"])


def read_range(frames: DataFrame, start: int, end: int | None = None, key: str = "path") -> DataFrame:
    """Bytes [start, end) of each file (end None: all that follow), from the overlapping frames alone."""
    end = F.lit(end) if end is not None else F.lit((1 << 63) - 1)
    hit = overlapping_frames(frames, F.lit(start), end, key)
    low = F.greatest(F.lit(start) - F.col("begin"), F.lit(0)).alias("low")
    size = (F.least(end, F.col("begin") + F.col("uncompressed")) - F.greatest(F.lit(start), F.col("begin"))).alias("size")
    kinds = StructType([hit.schema[key], hit.schema["pos"], StructField("_b", BinaryType())])
    part = hit.select(key, "pos", "frame", "uncompressed", low, size).mapInArrow(_opened, kinds)
    return part.groupBy(key).agg(F.expr("listagg(_b) WITHIN GROUP (ORDER BY pos)").alias("content"))


def seek_table(frames: DataFrame, key: str = "path") -> DataFrame:
    """The frames of each file as JSON."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "uncompressed", "compressed", F.col("stored_at").alias("offset"))))
    return frame_offsets(frames, key).groupBy(key).agg(F.to_json(rows).alias("seek_table"))


def encrypt_chunks(chunks: DataFrame, secret: Column, key: str = "path") -> DataFrame:
    """AES-GCM of each chunk, bound to its position and file (a substitute for the original's cipher)."""
    bound = F.concat_ws(":", F.col(key).cast("string"), F.col("pos").cast("string"))
    return chunks.withColumn("sealed", F.aes_encrypt(F.col("chunk").cast("binary"), secret, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), bound.cast("binary")))


def decrypt_chunks(chunks: DataFrame, secret: Column, key: str = "path") -> DataFrame:
    bound = F.concat_ws(":", F.col(key).cast("string"), F.col("pos").cast("string"))
    return chunks.withColumn("opened", F.aes_decrypt("sealed", secret, F.lit("GCM"), F.lit("DEFAULT"), bound.cast("binary")).cast("string"))
