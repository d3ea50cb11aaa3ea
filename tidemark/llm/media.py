"""Media columns: interleaved sequences of texts and media references, payloads joined by digest.

A page's HTML becomes an ordered array of structs, one a text run or media element, with its position,
reference and caption.  Payloads are 8-bit mono WAV, which is lossless for any bytes, in a media table
with at most one copy of a digest a task of the write; ``media_features`` names one of the copies, so a digest
resolves to one payload.  References are resolved by a join on the digest that carries the payload's place
in the media table and what is asked for, never the bytes, and the sequences come back in order.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbatch as tb

#: Samples a second in the stored header, payload bytes are padded to a multiple of this.
RATE, PAD = 8000, 64
#: References that name a payload by its digest.
SCHEME = "sha256:"
ITEM = "struct<pos:int,kind:string,text:string,ref:string,caption:string>"
_MEDIA = {"img": "image", "audio": "audio", "video": "video"}
_HIDDEN = ("script", "style", "template", "noscript")
_VOID = ("br", "hr", "wbr")


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = self.in_caption = 0
        self.caption: list[str] = []
        self.in_figure: list[int] = []

    def _close_text(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag in _MEDIA:
            self._close_text()
            given = dict(attrs)
            self.items.append({"kind": _MEDIA[tag], "text": None, "ref": given.get("src"), "caption": given.get("alt") or given.get("title")})
        elif tag == "source" and self.items and self.items[-1]["kind"] in ("audio", "video") and not self.items[-1]["ref"]:
            self.items[-1]["ref"] = dict(attrs).get("src")
        elif tag == "figure":
            self._close_text()
            self.in_figure.append(len(self.items))
        elif tag == "figcaption":
            self.in_caption += 1
            self.caption = []
        elif tag in ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "article", "section", "table", "blockquote", "pre"):
            self._close_text()
        elif tag in _VOID:
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.in_caption:
            self.in_caption -= 1
            said = " ".join("".join(self.caption).split())
            first = self.in_figure[-1] if self.in_figure else max(0, len(self.items) - 1)
            for item in self.items[first:]:
                if item["kind"] != "text":
                    item["caption"] = said
        elif tag == "figure" and self.in_figure:
            self._close_text()
            self.in_figure.pop()
        elif tag in ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "article", "section", "table", "blockquote", "pre"):
            self._close_text()

    def handle_data(self, data):
        if self.hidden:
            return
        (self.caption if self.in_caption else self.text).append(data)


def parse_html(html: str | None) -> list[dict]:
    """Ordered items of one page; a figure's caption goes to all media in it.  Null: no item."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser._close_text()
    return [{"pos": i, **item} for i, item in enumerate(parser.items)]


def sequences(pages: DataFrame, html: str = "html", into: str = "items") -> DataFrame:
    """All columns of pages and, as ``into``, the ordered items.  Broken markup yields what can be read."""
    kept = pages.drop(into)
    where = kept.columns.index(html)
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, html):
            made = [parse_html(x) for x in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], names=[*batch.schema.names, into])

    return kept.mapInArrow(run, tb.widened(kept.schema, into, f"array<{ITEM}>"))


def pad(payload: bytes, multiple: int = PAD) -> bytes:
    """Zero bytes up to a positive multiple."""
    return payload + b"\0" * (max(1, -(-len(payload) // multiple)) * multiple - len(payload))


def to_wav(payload: bytes) -> bytes:
    """Unsigned 8-bit mono samples; each byte is one sample."""
    odd = len(payload) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload + b"\0" * odd


def from_wav(stored: bytes) -> bytes:
    """The samples of an 8-bit mono WAV; anything else is an error."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt " and struct.unpack_from("<HH", stored, at + 8) + struct.unpack_from("<H", stored, at + 22) != (1, 1, 8):
            raise ValueError("not 8-bit mono samples")
        if name == b"data":
            if at + 8 + size > len(stored):
                raise ValueError("the samples are cut short")
            return stored[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def store_media(docs: DataFrame, out: str, text: str = "text") -> None:
    """Write each distinct text of a task once: (digest, n_bytes, media).  Null counts as empty.

    The digest is SHA-256 of the text's UTF-8 bytes.  Copies in other tasks are written by those too
    (equal rows, of which ``media_features`` names one a digest), so payloads never pass a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written: set[bytes] = set()  # 32 bytes a text of the task
        for batch in tb.slices(batches, "text"):
            data, at = tb.utf8(batch.column(0))
            raw, seen = data.tobytes(), {}
            for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                payload = raw[b:e]
                digest = hashlib.sha256(payload)
                if digest.digest() not in written:
                    written.add(digest.digest())
                    seen[digest.hexdigest()] = (e - b, to_wav(pad(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.binary())], names=["digest", "n_bytes", "media"])

    docs.select(F.col(text).alias("text")).mapInArrow(run, "digest string, n_bytes long, media binary").write.option("compression", "zstd").parquet(out)


def describe(samples: bytes) -> str:
    """Features of 8-bit samples: mean, deviation, sign changes around the mean, byte entropy."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    mean = float(counts @ np.arange(256)) / len(x)
    deviation = float(np.sqrt(max(0.0, counts @ np.arange(256) ** 2 / len(x) - mean**2)))
    turns = int(np.count_nonzero(np.diff(x > mean)))
    return f"mean={mean:.4f};dev={deviation:.4f};turns={turns};bits={float(-(p * np.log2(p)).sum()):.4f}"


def media_features(media: DataFrame) -> DataFrame:
    """One row a digest, from the stored bytes: media_file (the media table's file that holds the payload, of
    several the first), n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    media must be read from files.  Copies of a digest in several files give equal rows, of which one stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for n, stored in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                held = stored.as_py()
                samples = from_wav(held)
                for name, value in zip(rows, (n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-PAD:]), len(held), hashlib.sha256(held).hexdigest(), describe(samples)), strict=True):
                    rows[name].append(value)
            kinds = [pa.string() if name in ("payload_sha256", "media_sha256", "feature") else pa.int64() for name in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True))], names=["digest", "media_file", *rows])

    schema = "digest string, media_file string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    found = media.select("digest", F.col("_metadata.file_name").alias("media_file"), "n_bytes", "media").mapInArrow(run, schema)
    one = F.min(F.struct(*[c for c in found.columns if c != "digest"])).alias("one")
    return found.groupBy("digest").agg(one).select("digest", "one.*")


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def resolve(pages: DataFrame, resolved: DataFrame, key: str, items: str = "items", texts: bool = False) -> DataFrame:
    """(key, pos, kind, text, ref, caption, digest, and resolved's columns): one row an item, in ``pos``
    order within a page; a reference without a payload, and text, have nulls.  With texts, a text run too has
    the digest of its bytes, so that it resolves to a payload that is equal to it.

    resolved has one row a digest.  A digest that a third of all references name is one row on that
    side; Spark's skew join splits the references' side.
    """
    each = pages.select(F.col(key).alias(key), F.explode(items).alias("item")).select(key, "item.*")
    digest = F.when(F.startswith("ref", F.lit(SCHEME)), F.substring("ref", len(SCHEME) + 1, 64))
    if texts:
        digest = F.when(F.col("kind") == "text", digest_of(F.col("text"))).otherwise(digest)
    return each.withColumn("digest", digest).join(resolved, "digest", "left")


def as_page(doc_id: Column, text: Column, caption: Column) -> Column:
    """A document as HTML: one figure whose audio is the payload with the text's digest."""
    return F.concat(F.lit("<article><h1>document "), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit('</h1><figure><audio src="' + SCHEME), digest_of(text), F.lit('"></audio><figcaption>'), F.coalesce(caption, F.lit("")), F.lit("</figcaption></figure></article>"))


def document_media(docs: DataFrame, out: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document as a page with its text as media: doc_id, pos, caption, media_file and the payload's features.

    Texts are read twice (to store them, and for their digests); only digests and features shuffle.
    """
    store_media(docs, out, text)
    pages = docs.select(F.col(doc_id).cast("long").alias("doc_id"), as_page(F.col(doc_id), F.col(text), F.concat(F.lit("text of document "), F.coalesce(F.col(doc_id).cast("string"), F.lit("?")))).alias("html"))
    spark = docs.sparkSession
    kept = f"{out}-features"
    media_features(spark.read.parquet(out)).write.parquet(kept)  # so that the join's skew can be split
    features = spark.read.parquet(kept)
    found = resolve(sequences(pages), features, "doc_id").where("kind = 'audio'")
    return found.select("doc_id", "pos", "caption", "media_file", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def page_items(pages: DataFrame, docs: DataFrame, out: str, key: str = "page_id", html: str = "html", text: str = "text") -> DataFrame:
    """The items of real pages, one row each: (key, pos, kind, text, ref, caption, digest) and the payload's place
    and size where a document's text is what a reference names, or what a text run says.

    Null and empty pages give no row; extra columns of either table do not take part."""
    spark = docs.sparkSession
    store_media(docs, out, text)
    media_features(spark.read.parquet(out)).write.parquet(f"{out}-features")
    features = spark.read.parquet(f"{out}-features").select("digest", "media_file", "n_bytes", "media_sha256")
    return resolve(sequences(pages.select(F.col(key).alias(key), F.col(html).alias("html"))), features, key, texts=True)
