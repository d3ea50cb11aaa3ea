"""Token counts that follow edits: a segment tree of pre-tokens for each document.

The leaves are the text's pre-tokens (matches of the pattern) with their characters and tokens; each
inner node holds its children's sums.  An edit is found by descending the character sums.  Only the
pre-tokens that it touches are matched and encoded again, with boundary context: matching restarts at
the last pre-token that ends at least two characters before the edit (no alternative of the pattern
looks further ahead), and stops as soon as a match begins where an old pre-token began after the edit,
since from there on both texts match alike.  Sums are then updated along the changed leaves' paths.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbatch as tb
from tidemark.llm.byte_bpe import WHITE, read_ranks
from tidemark.operators.checkpoints import kept
from tidemark.sources import tables

#: Characters beyond a match's end that the pattern may look at.
LOOK_AHEAD = 2
#: Pre-tokens in one leaf of a new tree; a leaf that would hold over four times as many rebuilds it.
FAN_OUT = 64
#: A segment that is one pre-token.
ASCII_WORD = re.compile(rb" ?[A-Za-z]+")


class Encoder:
    """Pre-token matcher and cached token counts of one rank file."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.coding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        self.known: dict[str, int] = {}
        self.cuts, self.cache = pattern == tb.CUT_PATTERN, tb.Cache()

    def count(self, piece: str) -> int:
        if (n := self.known.get(piece)) is None:
            n = len(self.coding.encode_ordinary(piece))
            if len(self.known) >= 400_000:
                self.known.clear()
            self.known[piece] = n
        return n

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """(characters, tokens) of each pre-token."""
        pieces = self.find.findall(text)
        return list(map(len, pieces)), list(map(self.count, pieces))

    def _pairs(self, pieces: list[bytes]) -> list[bytes]:
        """``leaves`` of segments as pairs of numbers; one of ASCII letters, after a space or none, is one pre-token."""
        out, word, pair, encode = [], ASCII_WORD.fullmatch, struct.Struct("<ii").pack, self.coding.encode_ordinary
        for piece in pieces:
            text = piece.decode()
            if self.cuts and word(piece):
                out.append(pair(len(text), len(encode(text))))
            else:
                out.append(b"".join(map(pair, *self.leaves(text))))
        return out

    def leaf_columns(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """``leaves`` of each text as two columns of lists; each distinct segment of a slice is matched once."""
        found = tb.segments(*tb.utf8(texts), cuts=self.cuts)
        flat, at = tb.expand(found, self.cache.encode(found.distinct(), self._pairs), np.dtype([("chars", "<i4"), ("tokens", "<i4")]))
        ends = pa.array(at, pa.int32())
        return tuple(pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(flat[name]))) for name in ("chars", "tokens"))


class CountTree:
    """Segment tree of one document: leaves are short runs of pre-tokens, node i has children 2i and 2i + 1.

    ``chars`` and ``tokens`` hold each node's sums; leaf b is node ``width + b``.  An edit is found from
    the root by the character sums, and changed leaves send their new sums up their paths."""

    def __init__(self, text: str, encoder: Encoder):
        self.text, self.encoder = text, encoder
        self._build(*encoder.leaves(text))

    @classmethod
    def kept(cls, text: str, chars: list[int], tokens: list[int], encoder: Encoder) -> CountTree:
        """The tree of leaves that were written before: nothing is matched or encoded."""
        tree = cls.__new__(cls)
        tree.text, tree.encoder = text, encoder
        tree._build(chars, tokens)
        return tree

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.blocks = [(chars[i : i + FAN_OUT], tokens[i : i + FAN_OUT]) for i in range(0, len(chars), FAN_OUT)] or [([], [])]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for b, (c, t) in enumerate(self.blocks):
            self.chars[self.width + b], self.tokens[self.width + b] = sum(c), sum(t)
        for i in range(self.width - 1, 0, -1):
            self._add_up(i)

    def _add_up(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _locate(self, position: int) -> tuple[int, int, int]:
        """(block, pre-token in it, character where that begins) of the pre-token over a position, or the last."""
        node, begin = 1, 0
        while node < self.width:
            left = self.chars[2 * node]
            if position < begin + left or not self.chars[2 * node + 1]:
                node = 2 * node
            else:
                node, begin = 2 * node + 1, begin + left
        block = node - self.width
        sizes = self.blocks[block][0] if block < len(self.blocks) else []
        for leaf, size in enumerate(sizes):
            if begin + size > position or leaf == len(sizes) - 1:
                return block, leaf, begin
            begin += size
        return block, 0, begin

    def edit(self, position: int, removed: int, inserted: str) -> int:
        """Replace ``removed`` characters at a position by others; returns the characters encoded again.

        Positions are clipped to the text.  The leaves equal those of a tree built from the edited text."""
        position = min(max(position, 0), len(self.text))
        removed = min(max(removed, 0), len(self.text) - position)
        if not removed and not inserted:
            return 0
        new = self.text[:position] + inserted + self.text[position + removed :]
        shift = len(inserted) - removed
        # restart where a match may have looked at the first changed character
        block, leaf, begin = self._locate(max(0, position - LOOK_AHEAD - 1))
        old = self._walk(block, leaf, begin)  # old pre-tokens, in step with the new matches
        ahead = next(old, None)
        chars, tokens, at = [], [], begin
        stop = None
        while at < len(new):
            while ahead is not None and (ahead[2] < position + removed or ahead[2] + shift < at):
                ahead = next(old, None)
            if ahead is not None and ahead[2] + shift == at and at >= position + len(inserted):
                stop = ahead
                break
            piece = self.encoder.find.match(new, at).group()
            chars.append(len(piece))
            tokens.append(self.encoder.count(piece))
            at += len(piece)
        self.text = new
        self._replace(block, leaf, stop, chars, tokens)
        return at - begin

    def _walk(self, block: int, leaf: int, begin: int) -> Iterator[tuple[int, int, int]]:
        while block < len(self.blocks):
            sizes = self.blocks[block][0]
            while leaf < len(sizes):
                yield block, leaf, begin
                begin += sizes[leaf]
                leaf += 1
            block, leaf = block + 1, 0

    def _replace(self, block: int, leaf: int, stop: tuple[int, int, int] | None, chars: list[int], tokens: list[int]) -> None:
        """Put new pre-tokens for those from (block, leaf) up to ``stop`` (None: to the end)."""
        last, rest = (stop[0], stop[1]) if stop is not None else (len(self.blocks) - 1, None)
        tail_c, tail_t = ([], []) if rest is None else (self.blocks[last][0][rest:], self.blocks[last][1][rest:])
        chars = self.blocks[block][0][:leaf] + chars + tail_c
        tokens = self.blocks[block][1][:leaf] + tokens + tail_t
        slots = last - block + 1
        per = -(-len(chars) // slots)
        if per > 4 * FAN_OUT:  # no room in these leaves: rebuild the tree from the counts at hand
            after = [x for c, _ in self.blocks[last + 1 :] for x in c], [x for _, t in self.blocks[last + 1 :] for x in t]
            head = [x for c, _ in self.blocks[:block] for x in c], [x for _, t in self.blocks[:block] for x in t]
            self._build(head[0] + chars + after[0], head[1] + tokens + after[1])
            return
        for i in range(slots):
            part = chars[i * per : (i + 1) * per], tokens[i * per : (i + 1) * per]
            self.blocks[block + i] = part
            node = self.width + block + i
            self.chars[node], self.tokens[node] = sum(part[0]), sum(part[1])
        low, high = (self.width + block) // 2, (self.width + last) // 2
        while low:
            for node in range(low, high + 1):
                self._add_up(node)
            low, high = low // 2, high // 2

    def leaves(self) -> tuple[list[int], list[int]]:
        return [x for c, _ in self.blocks for x in c], [x for _, t in self.blocks for x in t]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One encoder a worker process, kept between tasks."""
    if (key := (ranks_path, pattern)) not in _encoders:
        _encoders[key] = Encoder(ranks_path, pattern)
    return _encoders[key]


def count_with_edits(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """Token counts before and after each document's edits, by tree updates.

    edits: a column array<struct<position:int,removed:int,inserted:string>>, applied in order; null
    or empty: none.  Positions count characters.  Returns doc_id, n_pretokens, n_tokens (before),
    n_edits, n_chars_after, n_tokens_after, reencoded_chars, text_after_sha256.  Null texts count as empty.
    Documents with their edits are rows of one narrow pass: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        enc = encoder(ranks_path, pattern)
        for batch in tb.slices(batches, "text", 2 << 20):
            rows = []
            for body, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tree = CountTree(body or "", enc)
                before, leaves, again = tree.n_tokens, sum(len(c) for c, _ in tree.blocks), 0
                for change in changes or []:
                    if change is not None:
                        again += tree.edit(change["position"] or 0, change["removed"] or 0, change["inserted"] or "")
                rows.append((leaves, before, len(changes or []), len(tree.text), tree.n_tokens, again, hashlib.sha256(tree.text.encode()).hexdigest()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1])], names=["doc_id", "n_pretokens", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "reencoded_chars", "text_after_sha256"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(edits).alias("edits"))
    return given.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, n_edits long, n_chars_after long, n_tokens_after long, reencoded_chars long, text_after_sha256 string")


#: Columns of a table of trees: leaves in order, from which the inner sums follow.
TREES = "doc_id long, text string, chars array<int>, tokens array<int>"


def _tree_batch(ids: pa.Array, trees: list[CountTree], again: list[int]) -> pa.RecordBatch:
    leaves = [t.leaves() for t in trees]
    columns = [ids, pa.array([t.text for t in trees], pa.string()), pa.array([c for c, _ in leaves], pa.list_(pa.int32())), pa.array([n for _, n in leaves], pa.list_(pa.int32())), pa.array(again, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "chars", "tokens", "reencoded_chars"])


def plant(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The tree of each document as a row (TREES), to be written and kept.  A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in tb.slices(batches, "text", 4 << 20):
            texts = pc.fill_null(batch.column(1), "")
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, *enc.leaf_columns(texts)], names=["doc_id", "text", "chars", "tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, TREES)


def tend(trees: DataFrame, edits: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Kept trees after a log of edits (doc_id, seq, position, removed, inserted), applied by seq (then by the other
    columns): the columns of TREES and reencoded_chars, to be written as the next table of trees.

    Only edited documents are touched, and of them only the regions around each edit; the others pass as they are.
    Edits without a tree do nothing; rows that repeat a doc_id all get its edits."""
    log = edits.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "position", "removed", "inserted"))).alias("log"))

    given = trees.select("doc_id", "text", "chars", "tokens").join(log, "doc_id", "left").select("doc_id", "text", "chars", "tokens", "log")
    return given.mapInArrow(_tending(ranks_path, pattern), TREES + ", reencoded_chars long")


def _tending(ranks_path: str, pattern: str):
    """Rows of TREES and ``log``: those with edits grow, the others pass as they lie in Arrow's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for whole in tb.slices(batches, "text", 2 << 20):
            edited = whole.column(4).is_valid()
            rest, batch = whole.filter(pc.invert(edited)), whole.filter(edited)
            if rest.num_rows:
                yield pa.RecordBatch.from_arrays([*rest.columns[:4], pa.array(np.zeros(rest.num_rows, np.int64))], names=["doc_id", "text", "chars", "tokens", "reencoded_chars"])
            grown, again = [], []
            for body, chars, tokens, changes in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                tree = CountTree.kept(body or "", chars or [], tokens or [], enc)
                again.append(sum(tree.edit(c["position"] or 0, c["removed"] or 0, c["inserted"] or "") for c in changes))
                grown.append(tree)
            if grown:
                yield _tree_batch(batch.column(0), grown, again)

    return run


#: Bytes of a log that are sent to all tasks at once; trees of a bucket, about.
LOG_BYTES, TREES_A_BUCKET = 32 << 20, 20_000


def keep_trees(trees: DataFrame, out: str, buckets: int | None = None) -> None:
    """Trees as a table by buckets of doc_id, which ``tend_kept`` changes bucket by bucket."""
    rows = trees.select("doc_id", "text", "chars", "tokens")
    tables.create_buckets(rows, "doc_id", out, buckets or max(1, rows.count() // TREES_A_BUCKET))


def tend_kept(spark: SparkSession, out: str, edits: DataFrame, base: int, ranks_path: str, pattern: str, log_bytes: int = LOG_BYTES) -> int:
    """A log of edits, as for ``tend``, into kept trees at version ``base``; returns the new version.

    Only buckets of edited documents are read and replaced.  The log comes to the trees: buckets are taken together as
    long as their part of the log is at most ``log_bytes``, which is broadcast, so no text is shuffled; a bucket whose part is larger
    is joined by doc_id.  Documents without edits pass from file to file, past Python; edits without a tree do nothing.  New
    buckets are written once, beside the table, and moved into it when all are there."""
    buckets = tables.current_base(spark, out, base)
    log = kept(tables.in_bucket(edits.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "seq", "position", "removed", "inserted"), "doc_id", buckets), "log")
    sizes = log.groupBy("bucket").agg(F.sum(F.coalesce(F.octet_length("inserted"), F.lit(0)) + 64).alias("n")).orderBy("bucket").collect()  # a row a bucket
    groups: list[tuple[int, list[int]]] = []
    for r in sizes:
        if not groups or groups[-1][0] + r.n > log_bytes:
            groups.append((0, []))
        groups[-1] = (groups[-1][0] + r.n, [*groups[-1][1], r.bucket])
    staged = tables.beside(out)
    for size, some in groups:
        own = log.where(F.col("bucket").isin(some)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "position", "removed", "inserted"))).alias("log"))
        own = F.broadcast(own) if size <= log_bytes else own
        held = spark.read.parquet(out).where(F.col("bucket").isin(some)).select("doc_id", "text", "chars", "tokens", "bucket")
        grown = held.drop("bucket").join(own, "doc_id").mapInArrow(_tending(ranks_path, pattern), TREES + ", reencoded_chars long").drop("reencoded_chars")
        after = held.join(own, "doc_id", "left_anti").unionByName(tables.in_bucket(grown, "doc_id", buckets))
        after.write.mode("append").partitionBy("bucket").parquet(staged)
    return tables.move_buckets(spark, staged, out, base, buckets) if groups else base


def tree_counts(trees: DataFrame) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of a table of trees, without its texts."""
    return trees.select("doc_id", F.size("chars").cast("long").alias("n_pretokens"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_tokens"))


def sampled_edits(doc_id: str = "doc_id", text: str = "text", n: int = 3) -> Column:
    """An edit log for each document from its own content: at n hashed places, up to 40 characters go
    and a passage of up to 60 characters from another hashed place of the same text comes."""
    body = F.coalesce(F.col(text), F.lit(""))
    spot = lambda i, what: F.pmod(F.xxhash64(F.col(doc_id), F.lit(i), F.lit(what)), F.length(body) + 1).cast("int")
    size = lambda i, what, most: F.pmod(F.xxhash64(F.col(doc_id), F.lit(i), F.lit(what)), F.lit(most + 1)).cast("int")
    return F.array(*[F.struct(spot(i, "position").alias("position"), size(i, "removed", 40).alias("removed"), F.substr(body, spot(i, "from") + 1, size(i, "taken", 60)).alias("inserted")) for i in range(n)])
