"""Token-ID output: one wavelet matrix per shard of documents, written and read as a Spark table.

A shard holds the ids of consecutive documents (ascending doc_id).  Bit-plane k of its wavelet
matrix stores bit ``bits - 1 - k`` of every id, in the order left by stably moving the zeros of the
planes above to the front.  With a running count of ones each 512 bits, a plane answers rank and
select, and the planes together answer access, counting and occurrence lookup without unpacking.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import textbatch as tb

#: Bits of an id unless the vocabulary needs more (``TextEncoder.bits``).
BITS = 16
#: Tokens after which a shard is closed; only one longer document exceeds it.
SHARD_TOKENS = 1 << 19
#: Bits for each stored running count.
RANK_STEP = 512

SHARD_SCHEMA = "part int, shard int, start_in_part long, n_tokens long, doc_ids binary, doc_ends binary, bits int, planes binary, ranks binary"


class WaveletMatrix:
    """Succinct sequence of unsigned integers below 2 ** bits."""

    def __init__(self, n: int, bits: int, planes: bytes, ranks: bytes):
        self.n, self.bits = n, bits
        self.planes = np.frombuffer(planes, np.uint8).reshape(bits, -1)
        self.ranks = np.frombuffer(ranks, "<u4").reshape(bits, -1)
        self.zeros = [n - int(r[-1]) for r in self.ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = BITS) -> WaveletMatrix:
        n = len(ids)
        if n and int(ids.max()) >> bits:
            raise ValueError(f"an id needs more than {bits} bits")
        width = -(-n // RANK_STEP) * RANK_STEP // 8
        planes, ranks, order = np.zeros((bits, width), np.uint8), [], np.asarray(ids, np.uint16 if bits <= 16 else np.uint32)
        for k in range(bits):
            one = (order & order.dtype.type(1 << (bits - 1 - k))) != 0
            packed = np.packbits(one, bitorder="little")
            planes[k, : len(packed)] = packed
            counts = np.bitwise_count(planes[k].view(np.uint64)).reshape(-1, RANK_STEP // 64).sum(1) if width else np.zeros(0, np.uint32)
            ranks.append(np.concatenate(([0], np.cumsum(counts))).astype("<u4"))
            if k + 1 < bits:
                order = np.concatenate((order.take(np.flatnonzero(~one)), order.take(np.flatnonzero(one))))
        return cls(n, bits, planes.tobytes(), np.array(ranks, "<u4").tobytes())

    def rank1(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        block = i // RANK_STEP
        head = self.planes[k, block * RANK_STEP // 8 : -(-i // 8)]
        ones = int(np.bitwise_count(head).sum())
        if i % 8:
            ones -= int(np.bitwise_count(head[-1] >> np.uint8(i % 8)))
        return int(self.ranks[k, block]) + ones

    def select(self, k: int, bit: int, nth: int) -> int:
        """Position of the nth (from 0) ``bit`` of plane k."""
        held = self.ranks[k].astype(np.int64) if bit else np.arange(self.ranks.shape[1]) * RANK_STEP - self.ranks[k].astype(np.int64)
        block = int(np.searchsorted(held, nth, side="right")) - 1
        bits = np.unpackbits(self.planes[k, block * RANK_STEP // 8 : (block + 1) * RANK_STEP // 8], bitorder="little")
        return block * RANK_STEP + int(np.flatnonzero(bits == bit)[nth - held[block]])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            bit = int(self.planes[k, i // 8] >> (i % 8) & 1)
            value = value << 1 | bit
            i = self.zeros[k] + self.rank1(k, i) if bit else i - self.rank1(k, i)
        return value

    def _span(self, token: int, begin: int, end: int) -> tuple[int, int]:
        for k in range(self.bits):
            b, e = self.rank1(k, begin), self.rank1(k, end)
            begin, end = (self.zeros[k] + b, self.zeros[k] + e) if token >> (self.bits - 1 - k) & 1 else (begin - b, end - e)
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of a token at positions begin to end (exclusive)."""
        if token < 0 or token >> self.bits or not self.n:
            return 0
        b, e = self._span(token, begin, self.n if end is None else end)
        return e - b

    def locate(self, token: int) -> list[int]:
        """All positions of a token, ascending."""
        if token < 0 or token >> self.bits or not self.n:
            return []
        begin, end = self._span(token, 0, self.n)
        found = []
        for i in range(begin, end):
            for k in reversed(range(self.bits)):
                i = self.select(k, 1, i - self.zeros[k]) if token >> (self.bits - 1 - k) & 1 else self.select(k, 0, i)
            found.append(i)
        return sorted(found)

    def decode(self) -> np.ndarray:
        """All ids in order: from the last plane up, each plane's stable partition is undone."""
        value = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in reversed(range(self.bits)):
            one = np.unpackbits(self.planes[k], bitorder="little")[: self.n].view(bool)
            above = np.empty_like(value)
            above[np.flatnonzero(~one)] = value[: self.zeros[k]]
            above[np.flatnonzero(one)] = value[self.zeros[k] :] | value.dtype.type(1 << (self.bits - 1 - k))
            value = above
        return value


#: A piece that is one pre-token whatever stands around it: a space or none, then letters of Latin blocks.
ONE_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc9][\x80-\xbf])+")


def _byte_characters() -> str:
    """A byte-level vocabulary's character for each byte: itself if visible in Latin-1, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b if b in visible else next(spare)) for b in range(256))


class TextEncoder:
    """Whole texts to ids with the tokenizers library; each distinct segment is encoded once a task or so.

    Texts are cut only for a byte-level tokenizer of the pattern for which cuts are proved (no normalizer, no
    prefix space, no added token but special ones); any other tokenizer gets whole texts."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.bits = max(BITS, (self.tokenizer.get_vocab_size() - 1).bit_length())
        said = json.loads(self.tokenizer.to_str())
        split, kind = said["pre_tokenizer"] or {}, said["model"]["type"]
        self.cuts = said["normalizer"] is None and kind == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and all(t["special"] for t in said["added_tokens"])
        self.characters = _byte_characters()
        self.model = self.tokenizer.model
        self.cache = tb.Cache()

    def _many(self, pieces: list[bytes]) -> list[bytes]:
        """One-word pieces go to the library's model itself, the rest through its pre-tokenizer too.  Most are ASCII letters, which
        the vocabulary writes as they are, after a space or none: these need neither the pattern nor the table of characters."""
        out: list[bytes] = [b""] * len(pieces)
        rest = []
        word, tokenize, characters, space = ONE_WORD.fullmatch, self.model.tokenize, self.characters, self.characters[0x20]
        for i, piece in enumerate(pieces):
            if self.cuts and piece.isalpha():
                text = piece.decode()
            elif self.cuts and piece[:1] == b" " and piece[1:].isalpha():
                text = space + piece[1:].decode()
            elif self.cuts and word(piece):
                text = piece.decode("latin-1").translate(characters)
            else:
                rest.append(i)
                continue
            out[i] = array("I", [t.id for t in tokenize(text)]).tobytes()
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(x.ids, "<u4").tobytes()
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces = tb.segments(*tb.utf8(column), cuts=self.cuts)
        return tb.expand(pieces, self.cache.encode(pieces.distinct(), self._many), "<u4")


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder a worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def write_token_shards(docs: DataFrame, out: str, tokenizer_path: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode all documents in ascending doc_id order and write the shards to ``out``.

    Null and empty texts give only the end id (or nothing, without one).  Rows with a null doc_id
    sort first; rows that repeat a doc_id stay, next to each other.  Extra columns are ignored.
    A text column is shuffled once, by range of doc_id; nothing is gathered.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, done = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokenizer_path)
        ids: list[np.ndarray] = []
        docs_in: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            all_ids = np.concatenate(ids)
            m = WaveletMatrix.build(all_ids, max(enc.bits, int(end_id or 0).bit_length()))
            row = {"part": [part], "shard": [made], "start_in_part": [done], "n_tokens": [len(all_ids)], "doc_ids": [np.concatenate(docs_in).astype("<i8").tobytes()], "doc_ends": [np.cumsum(np.concatenate(sizes)).astype("<i8").tobytes()], "bits": [m.bits], "planes": [m.planes.tobytes()], "ranks": [m.ranks.tobytes()]}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for batch in tb.slices(batches, "text"):
            got, at = enc.encode(batch.column(1))
            if end_id is not None:  # after each document
                got = np.insert(got, at[1:], end_id)
                at = at + np.arange(len(at))
            keys = np.asarray(batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), np.int64)
            row = 0
            while row < len(keys):
                room = shard_tokens - sum(map(len, ids))
                stop = max(row + 1, int(np.searchsorted(at, at[row] + room, side="right")) - 1)
                stop = min(stop, len(keys))
                ids.append(got[at[row] : at[stop]])
                docs_in.append(keys[row:stop])
                sizes.append(np.diff(at[row : stop + 1]))
                row = stop
                if sum(map(len, ids)) >= shard_tokens or row < len(keys):
                    yield shard()
                    made, done = made + 1, done + sum(map(len, ids))
                    ids, docs_in, sizes = [], [], []
        if docs_in:
            yield shard()

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(build, SHARD_SCHEMA).write.option("compression", "zstd").parquet(out)


def _starts(shards: DataFrame) -> DataFrame:
    """Tokens before each part: one row a part, so the window orders as many rows as the write had tasks."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("of_part"))
    before = F.sum("of_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))


def read_token_shards(shards: DataFrame) -> DataFrame:
    """One row per document from the shard table: doc_id, start, n_tokens, ids_crc32, tokens."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
                ids = WaveletMatrix(row["n_tokens"].as_py(), row["bits"].as_py(), row["planes"].as_py(), row["ranks"].as_py()).decode().astype("<u4")
                keys, ends = np.frombuffer(row["doc_ids"].as_py(), "<i8"), np.frombuffer(row["doc_ends"].as_py(), "<i8")
                begins = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(ids[b:e]) for b, e in zip(begins, ends, strict=True)]
                first = row["part_start"].as_py() + row["start_in_part"].as_py()
                doc = pa.array(keys, mask=keys == np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays([doc, pa.array(begins + first), pa.array(ends - begins), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    full = shards.join(F.broadcast(_starts(shards)), "part")  # a row for each task of the write
    return full.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_counts(shards: DataFrame, token: int) -> DataFrame:
    """Occurrences of one token, by shard, from the bit-planes alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                m = WaveletMatrix(row["n_tokens"], row["bits"], row["planes"], row["ranks"])
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]], pa.int32()), pa.array([row["shard"]], pa.int32()), pa.array([m.count(token)], pa.int64())], names=["part", "shard", "n"])

    return shards.mapInArrow(count, "part int, shard int, n long")


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """Where a token stands: one row for each occurrence (part, shard, position in the shard, doc_id)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                m = WaveletMatrix(row["n_tokens"], row["bits"], row["planes"], row["ranks"])
                at = np.array(m.locate(token), np.int64)
                keys, ends = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_ends"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(at), pa.int32()), pa.array([row["shard"]] * len(at), pa.int32()), pa.array(at), pa.array(keys[np.searchsorted(ends, at, side="right")] if len(at) else at)], names=["part", "shard", "position", "doc_id"])

    return shards.mapInArrow(find, "part int, shard int, position long, doc_id long")
