"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are words (lower case, outer punctuation off) and, for words that are rare, their first
letters.  Each token's log-odds between toxic and other labelled texts has an informative Dirichlet
prior from all labelled text; tokens whose log-odds are not clear of their deviation count as neutral.
A text is then a sequence of scores (log-odds less a drift), and a linear scan finds all its maximal
scoring segments.  A segment's E-value follows the extreme-value law of such segments in texts without
toxicity, E = K n exp(-lambda S); the significant ones are aggregated and calibrated to P(toxic).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbatch as tb
from tidemark.llm.calibrate import Calibration, hashed_sample, labelled_ids, labelled_texts



class Constants(NamedTuple):
    """What the fit takes as given; the values below are those of least summed log-loss in
    ``cross_validate`` over the learnable rows of the 0.1 and 0.01 test tables (see the README)."""

    #: Pseudo-counts of the Dirichlet prior for each counted token.
    prior: float = 0.05
    #: Least |z| of a token that is not neutral.
    least_z: float = 3.0
    #: Taken from each token's log-odds, so that ordinary text drifts down.
    drift: float = 1.0
    #: A segment counts as significant up to this E-value.
    significant: float = 1.0


#: Words of a shingle; min-hashes of a text, those that lead to copies of it, and the share of equal ones in a copy.
SHINGLE, MIN_HASHES, LEADING, ALIKE = 5, 30, 3, 0.8
#: Lengths of the letter prefixes that stand in for words outside the lexicon.
PREFIXES = (4, 5, 6)
#: Labelled texts from which the token counts are learned (chosen by a hash of their ids).
LABELLED_TEXTS = 60_000
#: Those of them that fit the extreme-value law and the calibration.
CALIBRATION_TEXTS = 6000
_OUTER = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _tokens(words: list[bytes]) -> list[bytes]:
    return [w.decode(errors="replace").lower().encode().strip(_OUTER) for w in words]


def _prefixes(token: bytes) -> list[bytes]:
    """Keys of a token's letter prefixes (marked, so that none equals a whole token)."""
    text = token.decode(errors="replace")
    return [f"{text[:n]}\x00".encode() for n in PREFIXES if len(text) > n]


@dataclass
class ToxicityModel:
    lexicon: dict[bytes, tuple[float, float]] = field(default_factory=dict)  # log-odds, z
    rate: float = 1.0  # lambda of the extreme-value law
    scale: float = 0.1  # its K
    calibration: Calibration | None = None
    prior: float = 0.0
    constants: Constants = Constants()

    def token_scores(self, words: list[bytes]) -> np.ndarray:
        """By word: log-odds less the drift; 0 for words of punctuation alone.

        A word in the lexicon has its own log-odds; any other the clearest of its prefixes'."""
        out = np.full(len(words), -self.constants.drift)
        for i, token in enumerate(_tokens(words)):
            if not token:
                out[i] = 0.0
            elif (own := self.lexicon.get(token)) is not None:
                out[i] += own[0]
            else:
                known = [self.lexicon[k] for k in _prefixes(token) if k in self.lexicon]
                if known:
                    out[i] += max(known, key=lambda x: abs(x[1]))[0]
        return out

    def passages(self, column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, float, float]]]]:
        """(words of each text, its significant segments: first word, word after, score, E-value)."""
        found = tb.words(*tb.utf8(column))
        each = self.token_scores(found.distinct())[found.ids] if len(found.values) else np.zeros(0)
        sizes = np.diff(found.first)
        out: list[list[tuple[int, int, float, float]]] = [[] for _ in sizes]
        high = np.flatnonzero(each > 0)
        for doc in np.unique(np.searchsorted(found.first, high, side="right") - 1):
            begin, end = found.first[doc], found.first[doc + 1]
            for b, e, s in maximal_segments(each[begin:end]):
                value = self.scale * sizes[doc] * np.exp(-self.rate * s)
                if value <= self.constants.significant:
                    out[doc].append((b, e, s, float(value)))
        return sizes, out

    def evidence(self, column: pa.Array) -> np.ndarray:
        """By text: the summed -log E of its significant segments, and that of the strongest."""
        sizes, passages = self.passages(column)
        out = np.zeros((len(sizes), 2))
        for i, found in enumerate(passages):
            if found:
                each = -np.log(np.maximum([x[3] for x in found], 1e-300))
                out[i] = np.log1p(each.sum()), np.log1p(each.max())
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        x = self.evidence(column)
        return self.calibration(x) if self.calibration is not None else np.full(len(x), self.prior)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), by the linear scan of Ruzzo and Tompa.

    Only positions above zero open a segment, so the scan steps from one to the next; sums come from
    one running total.  Ties keep the earlier, shorter segment.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    held: list[tuple[int, int, float, float]] = []  # begin, end, total before, total after
    back: list[int] = []  # by segment: the last before it with a lower start total, or -1
    for i in np.flatnonzero(scores > 0).tolist():
        begin, left, right = i, total[i], total[i + 1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j = back[j]
            if j < 0 or held[j][3] >= right:
                held.append((begin, i + 1, left, right))
                back.append(j)
                break
            begin, left = held[j][0], held[j][2]
            del held[j:], back[j:]
    return [(b, e, float(r - s)) for b, e, s, r in held]


def min_hashes(column: pa.Array) -> np.ndarray:
    """By text: MIN_HASHES least hashes of its word shingles (of all its words if it has fewer)."""
    found = tb.words(*tb.utf8(column))
    seeds = np.arange(1, 2 * MIN_HASHES, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros((len(found.first) - 1, MIN_HASHES), np.uint64)
    word = np.fromiter(map(zlib.crc32, found.distinct()), np.uint64, len(found.values))[found.ids] if len(found.values) else np.zeros(0, np.uint64)
    for i, (b, e) in enumerate(zip(found.first[:-1], found.first[1:], strict=True)):
        size = min(SHINGLE, e - b)
        if size:
            h = np.zeros(e - b - size + 1, np.uint64)
            for k in range(size):
                h = (h ^ word[b + k : e - size + k + 1]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            out[i] = [((h ^ seed) * seed).min() for seed in seeds]
    return out


def without_copies(labelled: DataFrame) -> DataFrame:
    """(doc_id, y) of rows (doc_id, y, text) without near-copies: a text that was copied a thousand times must
    not make its ordinary words look toxic.

    A row goes if, among the rows of its label that share a leading min-hash with it, the one of least doc_id
    (null first) is another and agrees in ALIKE of all min-hashes.  Texts that only share a passage stay."""
    tb.use_checkpoints(labelled.sparkSession)  # signatures are made once, and each step reads the one before
    names = [f"h{i}" for i in range(LEADING)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text"):
            h = min_hashes(batch.column(2)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(h[:, i]) for i in range(LEADING)), pa.array(list(h), pa.list_(pa.int64()))], names=["doc_id", "y", *names, "sign"])

    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), "text").mapInArrow(run, f"doc_id long, y int, {', '.join(f'{n} long' for n in names)}, sign array<long>").checkpoint()
    for name in names:
        first = rows.groupBy("y", name).agg(F.min(F.struct("doc_id", "sign")).alias("first"))
        equal = F.size(F.filter(F.zip_with("sign", F.col("first.sign"), lambda a, b: a == b), lambda x: x))
        copy = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (equal >= ALIKE * MIN_HASHES)
        rows = rows.join(first, ["y", name]).where(~copy).drop("first").checkpoint()
    return rows.select("doc_id", "y").distinct()


def token_table(labelled: DataFrame) -> DataFrame:
    """(token, y0, y1): texts of each label that have the token, over rows (y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text"):
            y = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            found = tb.words(*tb.utf8(batch.column(1)))
            size = max(1, len(found.values))
            of_doc = np.repeat(np.arange(len(y)), np.diff(found.first))
            once = np.unique(of_doc * size + found.ids)
            ones = np.bincount(once % size, y[once // size], size).astype(np.int64)
            both = np.bincount(once % size, minlength=size)
            seen: dict[bytes, list[int]] = {}
            for token, a, n in zip(_tokens(found.distinct()), ones.tolist(), both.tolist(), strict=False):
                if token:
                    for key in (token, *_prefixes(token)):
                        got = seen.setdefault(key, [0, 0])
                        got[0] += n - a
                        got[1] += a
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["token", "y0", "y1"])

    return labelled.select("y", "text").mapInArrow(run, "token binary, y0 long, y1 long").groupBy("token").agg(F.sum("y0").alias("y0"), F.sum("y1").alias("y1"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n: int) -> DataFrame:
    """(doc_id, y, text) of at most n labelled documents outside the held-out fifth, written once to the shared
    folder: the texts of docs are read once, whatever is learned from them."""
    out = tb.shared_dir(docs.sparkSession, "toxic-sample")
    labelled_texts(docs, labelled_ids(labels, label, n)).write.parquet(out)
    return docs.sparkSession.read.parquet(out)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", labelled: int = LABELLED_TEXTS, calibration_texts: int = CALIBRATION_TEXTS, constants: Constants = Constants()) -> ToxicityModel:
    """Learn from labelled texts outside the held-out fifth, at most ``labelled`` of them; the lexicon is
    bounded by what they hold, and ``calibration_texts`` of them fit the calibration.  Without labels of both
    kinds every score is the share of label 1."""
    sample = labelled_sample(docs, labels, label, labelled)
    table = count_tokens(sample)
    model = learn(table, constants)
    if model is None:
        model = ToxicityModel(constants=constants)
        known = labels.where(~tb.held_out(F.col("doc_id"))).dropDuplicates(["doc_id"]).where(F.col(label).isin(0, 1))
        counts = {r.y: r.n for r in known.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n")).collect()}
        model.prior = counts.get(1, 0) / max(1, sum(counts.values()))
        return model
    some = hashed_sample(sample.select("doc_id").distinct(), calibration_texts)
    _calibrate(model, sample.join(F.broadcast(some), "doc_id", "left_semi").select("y", "text"))
    return model


def count_tokens(sample: DataFrame) -> DataFrame:
    """``token_table`` of the sample's texts but their copies, written once: it is read for totals and log-odds."""
    out = tb.shared_dir(sample.sparkSession, "toxic-tokens")
    kept = without_copies(sample).select("doc_id")  # bounded as the sample is
    token_table(sample.join(F.broadcast(kept), "doc_id", "left_semi")).write.parquet(out)
    return sample.sparkSession.read.parquet(out)


def learn(table: DataFrame, constants: Constants) -> ToxicityModel | None:
    """The lexicon of a token table: all tokens whose log-odds are clear (None without texts of both labels)."""
    sums = table.agg(F.sum("y0").alias("n0"), F.sum("y1").alias("n1")).first()
    n0, n1 = sums.n0 or 0, sums.n1 or 0
    if not n0 or not n1:
        return None
    share = (F.col("y0") + F.col("y1")) * constants.prior
    a1, a0, all_prior = F.col("y1") + share, F.col("y0") + share, constants.prior * (n0 + n1)
    odds = F.log(a1 / (n1 + all_prior - a1)) - F.log(a0 / (n0 + all_prior - a0))
    z = odds / F.sqrt(1 / a1 + 1 / a0)
    # a clear token stands in several texts of the sample, so the sample's bound is one of the lexicon
    got = table.select("token", odds.alias("odds"), z.alias("z")).where(F.abs("z") >= constants.least_z).toArrow()
    held = dict(zip(got.column("token").to_pylist(), zip(got.column("odds").to_pylist(), got.column("z").to_pylist(), strict=True), strict=True))
    return ToxicityModel(lexicon=dict(sorted(held.items())), constants=constants)


def cross_validate(docs: DataFrame, labels: DataFrame, grid: list[Constants], label: str = "toxic", labelled: int = LABELLED_TEXTS, calibration_texts: int = CALIBRATION_TEXTS) -> list[tuple[float, Constants]]:
    """(mean log-loss, constants), best first, over four folds of the rows that may be learned from: a fold's
    texts are scored by models that have not seen them.  Folds go by the remainder that the held-out rule takes,
    and no held-out row takes part."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    sample = labelled_sample(docs, labels, label, labelled).withColumn("fold", remainder)
    losses = {c: 0.0 for c in grid}
    n = 0
    for fold in range(1, 5):
        train, test = sample.where(F.col("fold") != fold).drop("fold"), sample.where(F.col("fold") == fold)
        table = count_tokens(train)
        some = hashed_sample(train.select("doc_id").distinct(), calibration_texts)
        calibrating = train.join(F.broadcast(some), "doc_id", "left_semi").select("y", "text")
        for constants in grid:
            model = learn(table, constants)
            if model is None:
                continue
            _calibrate(model, calibrating)

            def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
                for batch in tb.slices(batches, "text"):
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)), pa.float64())], names=["y", "p"])

            got = test.select("y", "text").mapInArrow(run, "y int, p double").toArrow()
            y, p = got.column("y").to_numpy(), np.clip(got.column("p").to_numpy(), 1e-6, 1 - 1e-6)
            losses[constants] -= float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
        n += test.count()
    return sorted((total / max(1, n), c) for c, total in losses.items())


def _calibrate(model: ToxicityModel, some: DataFrame) -> None:
    """lambda and K from the best segments of non-toxic texts, then P(toxic) from the evidence.

    log n + log K - lambda M is minus a standard Gumbel variable, so lambda is fitted by the spread of
    the best segments (between 0.3 and 3, and 3 when they do not vary), K by its likelihood.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text"):
            found = tb.words(*tb.utf8(batch.column(1)))
            each = model.token_scores(found.distinct())[found.ids] if len(found.values) else np.zeros(0)
            top = [max((s for _, _, s in maximal_segments(each[b:e])), default=0.0) for b, e in zip(found.first[:-1], found.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(found.first)), pa.array(top, pa.float64())], names=["y", "n", "best"])

    got = some.mapInArrow(best, "y int, n long, best double").toArrow()
    y, size, top = (got.column(c).to_numpy() for c in ("y", "n", "best"))
    null = (y == 0) & (size > 0)
    if null.any():
        spread = top[null].std()
        model.rate = float(np.clip(np.pi / (np.sqrt(6) * spread), 0.3, 3.0)) if spread > 0 else 3.0
        model.scale = float(null.sum() / (size[null] * np.exp(-model.rate * top[null])).sum())

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text"):
            x = model.evidence(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["y", "a", "b"])

    got = some.mapInArrow(evidence, "y int, a double, b double").toArrow()
    y = got.column("y").to_numpy()
    model.prior = float(y.mean()) if len(y) else 0.0
    if len(set(y.tolist())) == 2:
        model.calibration = Calibration(np.column_stack([got.column("a").to_numpy(), got.column("b").to_numpy()]), y)


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, passages): P(toxic) and the number of significant passages, for each row.
    Null and empty texts have no passage and the score of texts without one.  Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text"):
            _, found = model.passages(batch.column(1))
            each = [-np.log(np.maximum([p[3] for p in f], 1e-300)) if f else np.zeros(1) for f in found]
            x = np.array([[np.log1p(e.sum()), np.log1p(e.max())] for e in each]).reshape(-1, 2)
            made = model.calibration(x) if model.calibration is not None else np.full(len(x), model.prior)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made), pa.array([len(f) for f in found], pa.int32())], names=["doc_id", "score", "passages"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, "doc_id long, score double, passages int")


def annotate(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "toxicity") -> DataFrame:
    """All columns of docs and, as ``into``, each text's score; a column already named so is replaced."""
    kept = docs.drop(into)
    where = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, text):
            made = model.scores(batch.column(where))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, into])

    return kept.mapInArrow(run, tb.widened(kept.schema, into, "double"))
