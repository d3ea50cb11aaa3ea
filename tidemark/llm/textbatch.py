"""Columnar views of text batches shared by the operators of this subpackage.

Every helper works on the flat UTF-8 buffer of an Arrow string column, so that a task handles
millions of words with a few numpy calls instead of one Python object a word.  Nulls read as "".
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import checkpoints

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it

#: Bytes of text that a task turns into arrays at once; only one longer document exceeds it.
SLICE_BYTES = 8 << 20

#: The six ASCII white-space bytes that separate words (space, tab, \n, \v, \f, \r).
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that may follow a space at which a text is cut: no white space or control byte, and no
#: lead byte of a multi-byte white-space character (those start with C2, E1, E2 or E3).
CUT_BEFORE = np.ones(256, bool)
CUT_BEFORE[:0x21] = False
CUT_BEFORE[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False

#: ASCII letters, the marks that may follow one at a cut (an apostrophe may open a contraction), visible ASCII.
LETTER, MARK, VISIBLE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
VISIBLE[0x21:0x7F] = True

#: The pre-token pattern for which ``segments`` is proved: contractions, letters, numbers and other visible runs,
#: each after at most one space, and white space.
CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels no model may see (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


shared_dir, use_checkpoints = checkpoints.work_folder, checkpoints.ensure


def widened(schema: StructType, name: str, kind: str) -> StructType:
    """A schema with one more column, its type in DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(f"`{name}` {kind}").fields])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; text i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of the batches in runs of at most ``size`` bytes of text (at least one row each)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        row = 0
        while row < n:
            before = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(row, stop - row)
            row = stop
            give_back()


def give_back() -> None:
    """Return freed memory to the system, so that a reused worker does not keep a slice's peak."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


class Pieces:
    """The pieces (words or cut segments) of a slice of texts, dictionary-encoded.

    ids[i] is the number of piece i's text in ``values``; document d has pieces first[d]:first[d + 1].
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, first: np.ndarray):
        ends = np.append(starts, len(data)).astype(np.int64)
        array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = array.dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False)
        self.values: pa.Array = coded.dictionary
        self.first = first
        self.lengths = np.diff(ends)

    def distinct(self) -> list[bytes]:
        """``values`` as Python bytes."""
        _, ends, data = self.values.buffers()
        at = np.frombuffer(ends, np.int64)[self.values.offset : self.values.offset + len(self.values) + 1].tolist() if len(self.values) else [0]
        raw = memoryview(data)[at[0] : at[-1]].tobytes() if data is not None else b""
        return [raw[b - at[0] : e - at[0]] for b, e in zip(at[:-1], at[1:], strict=True)]

    def sums(self, each: np.ndarray) -> np.ndarray:
        """Per document, the sum of a number that each piece has (0 without pieces)."""
        return segment_sums(each, self.first)


def segment_sums(each: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(each, dtype=np.float64 if each.dtype.kind == "f" else np.int64)))
    return total[first[1:]] - total[first[:-1]]


def words(data: np.ndarray, offsets: np.ndarray) -> Pieces:
    """Maximal runs of bytes outside the six white-space bytes; none crosses a document's end."""
    solid = ~SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads] = solid[heads]
    at = np.flatnonzero(start)
    before = np.cumsum(solid, dtype=np.int64)
    return Pieces(data[solid], before[at] - 1 if len(at) else at, np.searchsorted(at, offsets))


def segments(data: np.ndarray, offsets: np.ndarray, cuts: bool = True) -> Pieces:
    """Texts cut where CUT_PATTERN always ends a match, so that encoding the pieces one by one equals
    encoding the whole text (cuts=False, for any other pattern: texts stay whole).

    - Before a space that a visible character follows: no run holds an inner space, and a run of white
      space before a visible character gives up its last space.
    - Between an ASCII letter and a mark other than the apostrophe: no alternative holds both.
    - Before and after a single line feed between visible ASCII characters: it is a match of its own.
    """
    cut = np.zeros(len(data), bool)
    if len(data):
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        if cuts:
            cut[:-1] = (data[:-1] == 0x20) & CUT_BEFORE[data[1:]]
            cut[1:] |= LETTER[data[:-1]] & MARK[data[1:]]
            feed = np.flatnonzero(data[1:-1] == 0x0A) + 1
            feed = feed[VISIBLE[data[feed - 1]] & VISIBLE[data[feed + 1]]]
            feed = feed[~np.isin(feed, last) & ~np.isin(feed - 1, last)]  # neighbours of the same text
            cut[feed] = cut[feed + 1] = True
            ends = last[data[last] == 0x20]
            cut[ends] = False  # what follows it is another text
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    at = np.flatnonzero(cut)
    return Pieces(data, at, np.searchsorted(at, offsets))


class Cache:
    """A bounded map from a piece's bytes to its codes: two generations of ``size`` entries."""

    def __init__(self, size: int = 300_000):
        self.size, self.new, self.old = size, {}, {}

    def encode(self, values: Sequence[bytes], many: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """The codes of each value; ``many`` makes those that are not held."""
        new, old = self.new.get, self.old.get
        out = [new(v) or old(v) for v in values]
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            made = many([values[i] for i in missing])
            for i, x in zip(missing, made, strict=True):
                out[i] = x
            if len(self.new) + len(missing) > self.size:
                self.new, self.old = {}, self.new
            self.new.update(zip([values[i] for i in missing[: self.size]], made[: self.size], strict=True))
        return out


def expand(pieces: Pieces, coded: list[bytes], dtype) -> tuple[np.ndarray, np.ndarray]:
    """All documents' codes in order, and the document offsets into them; coded: by distinct piece."""
    width = np.dtype(dtype).itemsize
    size = np.fromiter(map(len, coded), np.int64, len(coded)) // width
    flat = np.frombuffer(b"".join(coded), dtype)
    begin = np.concatenate(([0], np.cumsum(size)))[:-1] if len(size) else size
    count = size[pieces.ids] if len(pieces.ids) else np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(count)))
    where = np.arange(ends[-1]) + np.repeat(begin[pieces.ids] - ends[:-1], count) if ends[-1] else np.zeros(0, np.int64)
    return flat[where], ends[pieces.first]
