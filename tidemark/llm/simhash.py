"""SimHash near-duplicates: fingerprints, BK-tree shards searched within a radius, and components.

Fingerprints are grouped into classes of equal value first, so copies never meet each other.  The
distinct fingerprints go to shards: two that differ in at most r bits agree in one of r + 1 blocks of
bits, and among the other bits again in one of r + 1 blocks, so a shard is keyed by those two blocks
and every link lies in some shard (an exact cover; nothing is capped).  A shard of over MOST_IN_SHARD is
split by a block of its members' other bits, again and again: at the fifth block 15 bits are left (r = 3), so no
shard can hold more than MOST_IN_SHARD or 2 ** 15 fingerprints.  Each shard becomes a BK-tree:
a node's children are keyed by their Hamming distance to it, and a search follows only the edges
within the radius.  Shard trees travel by shuffle: broadcasting them would collect every document's
fingerprint on the driver.  A shard reports a star for each of its connected sets; the stars' links
are then joined into components by alternating large-star and small-star steps.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbatch as tb

#: Queries that walk a forest together; bounds the frontier of a search.
QUERIES_AT_ONCE = 1024
#: Shingles whose bits are counted together; bounds the memory of long texts.
SHINGLES_AT_ONCE = 1 << 17
#: Fingerprints of a shard that one task may hold; larger shards are split, up to so many blocks.
MOST_IN_SHARD, MOST_BLOCKS = 1 << 17, 5


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of one text: a bit is 1 if it is set in over half of the shingles' XXH64."""
    return int(fingerprints([text], words, seed)[0])


def fingerprints(texts: list[bytes], words: int = 3, seed: int = 42) -> np.ndarray:
    """SimHashes of UTF-8 texts: A-Z lower-cased, ``words``-word shingles with repeats; 0 without a word."""
    import xxhash

    xxh64 = xxhash.xxh64_intdigest
    hashes = array("Q")
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        split = text.lower().split()
        if not split:
            continue
        joined = b" ".join(split)
        if len(split) <= words:
            made = [xxh64(joined, seed)]
        else:
            ends = (np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1).tolist()
            begins = [0, *[e + 1 for e in ends[: -words]]]
            made = [xxh64(joined[b:e], seed) for b, e in zip(begins, ends[words - 1 :], strict=True)]
        counts[i] = len(made)
        hashes.extend(made)
    ones = np.zeros((len(texts), 64), np.int64)
    of_text = np.repeat(np.arange(len(texts)), counts)
    for begin in range(0, len(hashes), SHINGLES_AT_ONCE):
        some, of = np.array(hashes[begin : begin + SHINGLES_AT_ONCE], "<u8"), of_text[begin : begin + SHINGLES_AT_ONCE]
        head = np.flatnonzero(np.diff(of, prepend=-1))
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[of[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8")[:, 0] if len(texts) else np.zeros(0, np.uint64)


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row; a null text counts as empty.  Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text"):
            data, at = tb.utf8(batch.column(1))
            raw = data.tobytes()
            made = fingerprints([raw[b:e] for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, "doc_id long, fp long")


class BKForest:
    """BK-trees over many groups at once; group[i] says to which tree value i belongs (sorted)."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        n = len(values)
        self.values = values
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        self.root = np.flatnonzero(new)[np.cumsum(new) - 1]
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        waiting, at = np.flatnonzero(~new), self.root[~new]
        while len(waiting):  # one level of all trees a turn
            apart = np.bitwise_count(values[waiting] ^ values[at]).astype(np.int64)
            _, head, which = np.unique(at * 65 + apart, return_index=True, return_inverse=True)
            child = waiting[head]
            parent[child], edge[child] = at[head], apart[head]
            rest = child[which] != waiting
            waiting, at = waiting[rest], child[which][rest]
        node = np.flatnonzero(parent >= 0)
        key = parent[node] * 65 + edge[node]
        order = np.argsort(key, kind="stable")
        self.child, self.key = node[order], key[order]

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs (i < j) of a tree within the radius, in runs."""
        for begin in range(0, len(self.values), QUERIES_AT_ONCE):
            query = np.arange(begin, min(begin + QUERIES_AT_ONCE, len(self.values)))
            node = self.root[query]
            while len(query):
                apart = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
                near = (apart <= radius) & (query < node)
                if near.any():
                    yield query[near], node[near]
                low = np.searchsorted(self.key, node * 65 + np.maximum(apart - radius, 0))
                many = np.searchsorted(self.key, node * 65 + np.minimum(apart + radius, 64), side="right") - low
                query = np.repeat(query, many)
                node = self.child[np.arange(len(query)) + np.repeat(low - (np.cumsum(many) - many), many)]


def _least_reachable(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Union-find over runs of pairs: the least member of each item's connected set."""
    up = np.arange(n)

    def find(x: np.ndarray) -> np.ndarray:
        while not np.array_equal(above := up[x], x):
            x = above
        return x

    for a, b in pairs:
        while len(a):
            a, b = find(a), find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        up = find(up)
    return find(up)


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of equal blocks of a number's low bits."""
    edges = [round(bits * i / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def shard_keys(fp: Column, radius: int) -> Column:
    """Array of the keys of all shards to which a fingerprint belongs: (radius + 1) ** 2 of them."""
    keys, number = [], 0
    part = lambda x, shift, width: F.shiftrightunsigned(x, shift).bitwiseAND((1 << width) - 1)
    for shift, width in _blocks(64, radius + 1):
        above = F.shiftleft(F.shiftrightunsigned(fp, shift + width), shift) if shift + width < 64 else F.lit(0).cast("long")
        rest = above.bitwiseOR(fp.bitwiseAND((1 << shift) - 1)) if shift else above
        for inner, size in _blocks(64 - width, radius + 1):
            keys.append(F.shiftleft(part(fp, shift, width), size).bitwiseOR(part(rest, inner, size)).bitwiseOR(F.lit(number << (width + size)).cast("long")))
            number += 1
    return F.array(*keys)


def _other_bits(fp: np.ndarray, numbers: tuple[int, ...], radius: int) -> tuple[np.ndarray, int]:
    """(the bits outside the numbered blocks, how many they are)."""
    rest, bits = fp.view(np.uint64), 64
    for n in numbers:
        shift, width = _blocks(bits, radius + 1)[n]
        above = (rest >> np.uint64(shift + width)) << np.uint64(shift) if shift + width < 64 else np.zeros_like(rest)
        rest, bits = above | (rest & np.uint64((1 << shift) - 1)), bits - width
    return rest, bits


def _split(shards: DataFrame, radius: int) -> DataFrame:
    """(path, key, fp) of shards, each split by the agreeing blocks of its members' other bits: an exact cover
    of the links of each.  A new key is a hash: shards that share one by chance are searched together."""
    per = radius + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, key, fp = (batch.column(i).to_numpy() for i in range(3))
            for here in np.unique(path):  # path: the numbers of the blocks so far, in base per after a leading 1
                digits, x = [], int(here)
                while x > 1:
                    x, n = divmod(x, per)
                    digits.append(n)
                own = path == here
                rest, bits = _other_bits(fp[own], tuple(reversed(digits)), radius)
                for n, (shift, width) in enumerate(_blocks(bits, per)):
                    part = (rest >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    mixed = (key[own].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (part * np.uint64(per) + np.uint64(n))
                    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), int(here) * per + n)), pa.array(mixed.view(np.int64)), pa.array(fp[own])], names=["path", "key", "fp"])

    return shards.mapInArrow(run, "path long, key long, fp long")


def split_shards(distinct: DataFrame, radius: int = 3, most: int = MOST_IN_SHARD) -> DataFrame:
    """(key, fp): the shards of all distinct fingerprints, none above ``most`` as long as bits are left.

    Members are counted by a hash of the key in so many buckets that one above ``most`` is rare unless a
    shard is large; only the shards of such buckets are counted by key, so little is shuffled for it."""
    per = radius + 1
    total = distinct.count()
    keyed = distinct.select(F.posexplode(shard_keys(F.col("fp"), radius)).alias("number", "key"), "fp").select((F.lit(per * per) + F.col("number")).cast("long").alias("path"), "key", "fp")
    done: list[DataFrame] = []
    for blocks in range(2, MOST_BLOCKS):
        buckets = max(1 << 14, 8 * per**blocks * total // most)
        bucket = F.pmod(F.xxhash64("key"), F.lit(buckets))
        full = keyed.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("bucket").checkpoint()
        if full.isEmpty():
            break
        # at most a bucket for each ``most`` rows, and as many keys: bounded by rows / most
        hot = keyed.withColumn("bucket", bucket).join(full, "bucket", "left_semi").groupBy("path", "key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("path", "key").checkpoint()
        if hot.isEmpty():
            break
        done.append(keyed.join(hot, ["path", "key"], "left_anti"))
        keyed = _split(keyed.join(hot, ["path", "key"], "left_semi"), radius).checkpoint()
    for other in done:
        keyed = keyed.unionByName(other)
    return keyed.select("key", "fp")


def links(distinct: DataFrame, radius: int = 3, most: int = MOST_IN_SHARD) -> DataFrame:
    """Links (a, b), a > b as signed numbers, that connect all distinct fingerprints within the radius.

    distinct: one row for each fp.  Of the links of a shard, a star for each connected set is given,
    which has the same components; their number is linear in the shard.  A search yields each near pair
    once, in runs that union-find takes up at once: a member has at most C(b, 1) + ... + C(b, radius) near
    ones, b being the bits in which a shard may differ (36, 27, 20, 15), whatever the shard's size.
    """
    tb.use_checkpoints(distinct.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def found() -> pa.RecordBatch:
            key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            same = np.zeros(len(key), bool)
            same[1:] = key[1:] == key[:-1]
            same[:-1] |= same[1:]
            key, fp = key[same], fp[same]
            least = _least_reachable(len(fp), BKForest(fp.view(np.uint64), key).pairs(radius)) if len(fp) else np.zeros(0, np.int64)
            far = np.flatnonzero(least != np.arange(len(fp)))
            a, b = fp[far], fp[least[far]]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            whole = int(np.searchsorted(key, key[-1]))  # the last shard may go on in the next batch
            if whole or (held and held[-1][0][-1] != key[0]):
                held.append((key[:whole], fp[:whole]))
                yield found()
                held.clear()
            held.append((key[whole:], fp[whole:]))
        if held:
            yield found()

    shards = split_shards(distinct, radius, most)
    return shards.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of the links reaches; nodes without a link are absent.

    Alternating large-star and small-star steps, checkpointed each round, until nothing changes.
    """
    tb.use_checkpoints(edges.sparkSession)
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    sign = _signature(now)
    for _ in range(most_rounds):
        if not sign[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        before, sign = sign, _signature(now)
        if sign == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if sign[0]:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def near_duplicates(docs: DataFrame, radius: int = 3, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest doc_id reachable, itself included).

    Texts that are null or have no word have fingerprint 0 and link like any other.  Rows with a null
    doc_id get their component, but never name it (null if the component has no other row).
    """
    spark = docs.sparkSession
    out = tb.shared_dir(spark, "fingerprints")
    with_fingerprints(docs, doc_id, text, words).write.parquet(out)  # used twice; the texts are read once
    each = spark.read.parquet(out)
    classes = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes.write.parquet(f"{out}-classes")  # read for the shards, their counts and the result
    classes = spark.read.parquet(f"{out}-classes")
    joined = components(links(classes.select("fp"), radius))
    rooted = classes.join(joined, classes.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(of_root, "root").select("fp", "component_id")
    return each.join(of_class, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = 3, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """The rows of docs that stay: of each group of near-duplicates the one of least doc_id.

    A row that repeats another in every column counts once.  A null doc_id stays only where its whole
    group has none.  Texts pass one shuffle, by doc_id."""
    found = near_duplicates(docs, radius, doc_id, text, words)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stay")).distinct()
    out = tb.shared_dir(docs.sparkSession, "staying")
    stay.write.parquet(out)  # ids alone, read for rows with and without one
    stay = docs.sparkSession.read.schema(stay.schema).parquet(out)
    named = docs.where(F.col(doc_id).isNotNull()).join(stay.where("_stay IS NOT NULL"), docs[doc_id] == F.col("_stay"), "left_semi").dropDuplicates()
    nameless = docs.where(F.col(doc_id).isNull()).join(F.broadcast(stay.where("_stay IS NULL")), F.col("_stay").isNull(), "left_semi").dropDuplicates()  # one row at most
    return named.unionByName(nameless)
