"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into blocks, so that long texts keep leaning on the dictionary and not on their own
past.  Each block is compressed with either dictionary; the normalised difference of the summed
sizes, with the ratio of compression, is calibrated to P(label 1) on labelled texts that neither
dictionary has seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbatch as tb
from tidemark.llm.calibrate import Calibration, labelled_ids, labelled_texts

#: Bounds of the fit: labelled texts of each class, and characters of a text that may enter the fit.
SAMPLE_TEXTS, SAMPLE_CHARS = 2500, 20_000
#: Bytes of each dictionary, bytes of a block, and zstandard's level.
DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 1 << 16, 1 << 10, 3


def _blocks(text: bytes, size: int = BLOCK_BYTES) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


class Compressor:
    """Summed compressed sizes of a text's blocks under one dictionary (b"": none)."""

    def __init__(self, dictionary: bytes):
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if held is not None:
            held.precompute_compress(level=LEVEL)
        self.z = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)

    def size(self, text: bytes) -> int:
        return sum(len(self.z.compress(b)) for b in _blocks(text))


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    calibration: Calibration
    prior: float

    def features(self, texts: list[bytes]) -> np.ndarray:
        good, bad = Compressor(self.good), Compressor(self.bad)
        out = np.zeros((len(texts), 2))
        for i, t in enumerate(texts):
            if t:
                g, b = good.size(t), bad.size(t)
                out[i] = (g - b) / (g + b), np.log(min(g, b) / len(t))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        made = self.calibration(_shape(self.features(texts))) if texts else np.zeros(0)
        return np.where([not t for t in texts], self.prior, made) if texts else made


def _shape(x: np.ndarray) -> np.ndarray:
    """The difference, the ratio, their product and the ratio squared."""
    return np.column_stack([x, x[:, 0] * x[:, 1], x[:, 1] ** 2])


def _dictionary(texts: list[bytes]) -> bytes:
    """Trained by zstandard; where the samples are too few for that, their raw end."""
    samples = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE_TEXTS) -> QualityModel:
    """Fit on labelled rows outside the held-out fifth: a bounded sample of each class (see the constants).

    Rows without text or label are skipped.  Without both classes every score is the share of label 1
    (0.5 without labels).
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(~tb.held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    # bounded: 2 * sample texts of at most SAMPLE_CHARS characters
    rows = labelled_texts(docs, labelled_ids(labels, label, sample, (0, 1)), SAMPLE_CHARS).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.text))
    texts, y = [r.text.encode() for r in rows], [r.y for r in rows]
    labels_of = np.array(y)
    for_fit = np.arange(len(texts)) % 3 > 0  # a third calibrates
    good = _dictionary([t for t, k, f in zip(texts, y, for_fit, strict=True) if k == 1 and f]) if 1 in y else b""
    bad = _dictionary([t for t, k, f in zip(texts, y, for_fit, strict=True) if k == 0 and f]) if 0 in y else b""
    model = QualityModel(good, bad, Calibration(np.zeros((0, 4)), np.zeros(0)), prior)
    held = [t for t, f in zip(texts, for_fit, strict=True) if not f]
    y_held = labels_of[~for_fit] if len(texts) else np.zeros(0)
    if len(set(y_held.tolist())) == 2:
        model.calibration = Calibration(_shape(model.features(held)), y_held)
        # the sample is balanced by class; move the intercept to the labels' own shares
        odds = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) - np.log(y_held.mean() / (1 - y_held.mean()))
        model.calibration.weights[0] += odds
    else:
        model.calibration.weights[0] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    return model


def _texts(column: pa.Array) -> list[bytes]:
    data, at = tb.utf8(column)
    raw = data.tobytes()
    return [raw[b:e] for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def score(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for each row.  Empty and null texts score the share of label 1.  Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text"):
            made = model.scores(_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], names=["doc_id", "score"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, "doc_id long, score double")


def annotate(docs: DataFrame, model: QualityModel, text: str = "text", into: str = "quality") -> DataFrame:
    """All columns of docs and, as ``into``, each text's score; a column already named so is replaced."""
    kept = docs.drop(into)
    where = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, text):
            made = model.scores(_texts(batch.column(where)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, into])

    return kept.mapInArrow(run, tb.widened(kept.schema, into, "double"))
