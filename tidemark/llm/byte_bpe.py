"""Byte-level BPE as recursive DuckDB queries over token-position rows, run in each Spark partition.

A word (one match of the pre-token pattern) starts as one row a byte.  The merge table holds every
pair of tokens whose joined bytes are a token too, with that token's rank; the recursive query joins
adjacent rows with it and contracts each word's leftmost pair of least rank until no pair is left.
Decoding joins ids with the vocabulary and aggregates the bytes in position order.

Each distinct word is encoded once a slice; a bounded cache keeps words between slices.  Words over
LONGEST_WORD bytes (no natural word) are contracted by the same rule with a heap, in memory linear in
the word.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbatch as tb


class Room(NamedTuple):
    """What a worker may hold: bytes of text at once, words in one recursive query, and entries of the
    caches of words, segments and decoded runs.  Results do not depend on it."""

    slice_bytes: int
    words_at_once: int
    words: int
    pieces: int
    runs: int


#: About 0.4 GB a worker, for executors that other stages share; about 0.9 GB, for fewer words encoded twice.
FRUGAL = Room(2 << 20, 10_000, 100_000, 40_000, 40_000)
ROOMY = Room(12 << 20, 60_000, 450_000, 150_000, 250_000)
#: Rows that the steps of one recursive query may keep (a word of n bytes: n * n / 2 at most).
ROWS_AT_ONCE = 4_000_000
#: Longer words (bytes) would make the recursion's rows grow with their square: they are contracted
#: by the same rule with a heap.
LONGEST_WORD = 512
#: White space as the rank files' own library reads \s (Unicode White_Space).
WHITE = r"\t-\r \x85\xa0  -     　"

#: key = rank * 2^24 + position orders a word's pairs by rank, then from the left.
ENCODE = """
WITH RECURSIVE rows_of AS (
  SELECT 0 AS step, n.w, n.pos, n.tok, n.right_tok, n.right_pos, m.rank
  FROM (SELECT w, pos, tok, lead(tok) OVER spot AS right_tok, lead(pos) OVER spot AS right_pos
        FROM bytes_of_words WINDOW spot AS (PARTITION BY w ORDER BY pos)) n
  LEFT JOIN merges m ON m.pair = n.tok::BIGINT * 16777216 + n.right_tok
  UNION ALL
  (WITH best AS MATERIALIZED (
     SELECT w, min(rank::BIGINT * 16777216 + pos) AS key, arg_min(right_pos, rank::BIGINT * 16777216 + pos) AS gone
     FROM rows_of WHERE rank IS NOT NULL GROUP BY w),
   marked AS (
     SELECT r.*, (b.key % 16777216)::INT AS at_pos, (b.key // 16777216)::INT AS merged, b.gone
     FROM rows_of r JOIN best b ON r.w = b.w),
   absorbed AS (SELECT w, right_tok, right_pos FROM marked WHERE pos = gone),
   contracted AS (
     SELECT x.step + 1 AS step, x.w, x.pos,
       CASE WHEN x.pos = x.at_pos THEN x.merged ELSE x.tok END AS tok,
       CASE WHEN x.pos = x.at_pos THEN a.right_tok WHEN x.right_pos = x.at_pos THEN x.merged ELSE x.right_tok END AS right_tok,
       CASE WHEN x.pos = x.at_pos THEN a.right_pos ELSE x.right_pos END AS right_pos,
       x.rank AS old_rank, x.pos = x.at_pos OR coalesce(x.right_pos = x.at_pos, false) AS changed
     FROM marked x JOIN absorbed a ON x.w = a.w WHERE x.pos <> x.gone)
   SELECT c.step, c.w, c.pos, c.tok, c.right_tok, c.right_pos, CASE WHEN c.changed THEN m.rank ELSE c.old_rank END
   FROM contracted c LEFT JOIN merges m ON c.changed AND m.pair = c.tok::BIGINT * 16777216 + c.right_tok)
)
SELECT w, list(tok ORDER BY pos) AS ids FROM rows_of
WHERE (w, step) IN (SELECT (w, step) FROM rows_of GROUP BY w, step HAVING max(rank) IS NULL)
GROUP BY w ORDER BY w
"""

DECODE = """
SELECT d.run, array_to_string(list(v.chars ORDER BY d.pos), '') AS chars
FROM ids_of_runs d JOIN vocabulary v ON v.tok = d.tok GROUP BY d.run ORDER BY d.run
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBPE:
    """Encoder and decoder of one rank file and pre-token pattern; holds its own DuckDB connection."""

    def __init__(self, ranks_path: str, pattern: str, room: Room = FRUGAL):
        import duckdb

        self.room = room
        self.cuts = pattern == tb.CUT_PATTERN

        ranks = read_ranks(ranks_path)
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.merged: dict[tuple[int, int], int] = {}  # filled by the first very long word
        left, right, rank = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self.db.register("given", pa.table({"pair": left * 16777216 + right, "rank": rank.astype(np.int32)}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.register("given", pa.table({"tok": np.array([*ranks.values()], np.int32), "chars": [t.decode("latin-1") for t in ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.db.unregister("given")
        spaced = [rank for t, rank in ranks.items() if t[:1] == b" "]
        self.starts_run = np.zeros(max(ranks.values()) + 1, bool)
        self.starts_run[spaced] = True
        self.words, self.pieces, self.runs = tb.Cache(room.words), tb.Cache(room.pieces), tb.Cache(room.runs)

    def _contract(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [self._contract_long(w) if len(w) > LONGEST_WORD else b"" for w in words]
        short = [i for i, w in enumerate(words) if len(w) <= LONGEST_WORD]
        sizes = np.fromiter((len(words[i]) for i in short), np.int64, len(short))
        kept = np.cumsum(sizes * sizes // 2 + 1)
        begin = 0
        while begin < len(short):
            before = kept[begin - 1] if begin else 0
            end = max(begin + 1, min(begin + self.room.words_at_once, int(np.searchsorted(kept, before + ROWS_AT_ONCE, side="right"))))
            for i, ids in zip(short[begin:end], self._contract_words([words[i] for i in short[begin:end]], sizes[begin:end]), strict=True):
                out[i] = ids
            begin = end
        return out

    def _contract_words(self, words: list[bytes], sizes: np.ndarray) -> list[bytes]:
        """The recursive query over the words' rows."""
        data = np.frombuffer(b"".join(words), np.uint8)
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = (np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        self.db.register("bytes_of_words", pa.table({"w": w, "pos": pos, "tok": self.byte[data]}))
        ids = self.db.sql(ENCODE).to_arrow_table().column("ids").combine_chunks()
        raw, ends = np.asarray(ids.flatten(), "<u4").tobytes(), (4 * ids.offsets.to_numpy().astype(np.int64)).tolist()
        return [raw[b:e] for b, e in zip(ends[:-1], ends[1:], strict=True)]

    def _contract_long(self, word: bytes) -> bytes:
        """Least rank first, then leftmost, with a heap of candidate pairs and links between tokens."""
        if not self.merged:
            self.merged = {(pair >> 24, pair & 0xFFFFFF): rank for pair, rank in self.db.sql("SELECT pair, rank FROM merges").fetchall()}
        tok = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(tok)
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank, i, tok[i], tok[i + 1]) for i in range(n - 1) if (rank := self.merged.get((tok[i], tok[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if tok[i] != a or j < 0 or tok[j] != b:
                continue  # one of the two has been merged meanwhile
            tok[i], tok[j] = rank, -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (again := self.merged.get((tok[x], tok[y]))) is not None:
                    heapq.heappush(heap, (again, x, tok[x], tok[y]))
        return np.array([t for t in tok if t >= 0], "<u4").tobytes()

    def _segments(self, pieces: list[bytes]) -> list[bytes]:
        split = [[m.encode() for m in self.pattern.findall(p.decode())] for p in pieces]
        distinct = list({w for ws in split for w in ws})
        coded = dict(zip(distinct, self.words.encode(distinct, self._contract), strict=True))
        return [coded[ws[0]] if len(ws) == 1 else b"".join([coded[w] for w in ws]) for ws in split]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offset of each text's ids)."""
        pieces = tb.segments(*tb.utf8(column), cuts=self.cuts)
        return tb.expand(pieces, self.pieces.encode(pieces.distinct(), self._segments), "<u4")

    def _join(self, runs: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        tok = np.frombuffer(b"".join(runs), "<u4").astype(np.int32)
        rows = {"run": np.repeat(np.arange(len(runs), dtype=np.int32), sizes), "pos": np.arange(len(tok), dtype=np.int32), "tok": tok}
        self.db.register("ids_of_runs", pa.table(rows))
        return [x.encode("latin-1") for x in self.db.sql(DECODE).to_arrow_table().column("chars").to_pylist()]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, offset of each text's bytes).  Runs of ids are cut at tokens that start
        with a space; each distinct run is decoded once.  An id outside the vocabulary is an error."""
        if len(ids) and (ids.max() >= len(self.starts_run)):
            raise ValueError("an id is not in the vocabulary")
        cut = self.starts_run[ids]
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        at = np.flatnonzero(cut)
        raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8)
        runs = tb.Pieces(raw, 4 * at, np.searchsorted(at, offsets))
        return tb.expand(runs, self.runs.encode(runs.distinct(), self._join), np.uint8)


_coders: dict[tuple[str, str, Room], ByteBPE] = {}


def coder(ranks_path: str, pattern: str, room: Room = FRUGAL) -> ByteBPE:
    """One coder a worker process, kept between tasks."""
    if (key := (ranks_path, pattern, room)) not in _coders:
        _coders[key] = ByteBPE(ranks_path, pattern, room)
    return _coders[key]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """All columns of docs and, as ``into``, each text's ids.  A null text counts as empty: no ids.

    One narrow pass: no shuffle.  A column already named ``into`` is replaced.
    """
    kept = docs.drop(into)
    schema = tb.widened(kept.schema, into, "array<int>")
    where = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in tb.slices(batches, text, FRUGAL.slice_bytes):
            ids, at = bpe.encode(batch.column(where))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, into])

    return kept.mapInArrow(run, schema)


def decode_ids(coded: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """All columns and, as ``into``, the bytes that each row's ids stand for (null ids: no bytes)."""
    kept = coded.drop(into)
    schema = tb.widened(kept.schema, into, "binary")
    where = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                lists = some.column(where)
                at = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
                data, ends = bpe.decode(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), at)
                texts = pa.Array.from_buffers(pa.large_binary(), some.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*some.columns, texts.cast(pa.binary())], names=[*some.schema.names, into])

    return kept.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, room: Room = FRUGAL) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of decoded bytes, made slice by slice: what
    ``encode_texts`` and ``decode_ids`` give, without token lists passing through Spark.

    with_ids adds ``token_ids``: the ids as little-endian unsigned 32-bit integers, in one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern, room)
        for batch in tb.slices(batches, "text", room.slice_bytes):
            ids, at = bpe.encode(batch.column(1))
            data, ends = bpe.decode(ids, at)
            raw, back = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8), np.ascontiguousarray(data).data
            of_ids = [hashlib.sha256(raw.data[4 * b : 4 * e]).hexdigest() for b, e in zip(at[:-1], at[1:], strict=True)]
            of_text = [hashlib.sha256(back[b:e]).hexdigest() for b, e in zip(ends[:-1], ends[1:], strict=True)]
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(np.diff(at)), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())}
            if with_ids:
                columns["token_ids"] = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(np.ascontiguousarray(4 * at).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * with_ids)
