"""Language identification by interpolated Kneser-Ney character models, one a language.

Events are the letters of a word and its end, each after up to ORDER - 1 letters of that word (its
start counts as one).  Counts come from every learned document, by a shuffle on the n-gram; the model
keeps, for all languages together, one sorted hash array a length with a row of log-probabilities, and
one a context length with back-off weights.  Where these are too many to hold at once, they are cut into shards by the two
letters before the last, which n-grams and contexts of an event share: a task scores a slice's events shard by
shard and holds one at a time; none is left out.  A text goes to the language of least cross-entropy per
event; calibration gives a probability, and a bound per language beyond which a text is not accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbatch as tb
from tidemark.llm.calibrate import hashed_sample

ORDER = 5
#: Most cells (highest-order n-grams by languages) that a task holds at once; a larger model comes in shards (of so many at least).
MODEL_CELLS, LEAST_SHARD = 6_000_000, 4096
#: Cells (events by languages) that are scored together.
CELLS_AT_ONCE = 1 << 21
#: Documents that set the temperature and the bounds of acceptance.
CALIBRATION_TEXTS = 4000
#: Bytes of text at once: each byte is an event with a row of scores.
SLICE_BYTES = 3 << 20
#: Code points of a word's start and end (not letters, so never in a word).
EDGE = 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _events(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ngrams, word, letter): each event's last ORDER code points (0 beyond the word's start),
    its word's number, and whether it is a letter.  A run of other characters ends a word."""
    points = np.frombuffer("\n".join([w.decode(errors="replace") for w in words] + [""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)
    letter = _is_letter()[points]
    of_word = np.cumsum(points == 10) - (points == 10)
    after = np.zeros(len(points), bool)
    after[1:] = letter[:-1]
    event = letter | after  # a letter, or what follows one (the end of its word)
    run = np.arange(len(points)) - np.maximum.accumulate(np.where(letter, -1, np.arange(len(points))))
    run = np.where(letter, run, np.concatenate(([0], run[:-1])) + 1)  # events since the word's start
    code = np.where(letter, points, EDGE).astype(np.uint32)
    grams = np.zeros((int(event.sum()), ORDER), np.uint32)
    at = np.flatnonzero(event)
    grams[:, -1] = code[at]
    for back in range(1, ORDER):
        inside = run[at] - 1 >= back
        grams[inside, ORDER - 1 - back] = code[at[inside] - back]
        grams[run[at] - 1 == back - 1, ORDER - 1 - back] = EDGE  # the word's start
    return grams, of_word[at], letter[at]


def _hash(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of code points."""
    h = np.full(len(grams), np.uint64(grams.shape[1] + 1))
    for i in range(grams.shape[1]):
        h = (h ^ grams[:, i].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, c0..c4, n) over all documents with a language, outside the held-out fifth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text", SLICE_BYTES):
            langs = batch.column(0).dictionary_encode()
            names = langs.dictionary.to_pylist()
            found = tb.words(*tb.utf8(batch.column(1)))
            of_doc = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(found.first))
            both, seen = np.unique(of_doc.astype(np.int64) * max(1, len(found.values)) + found.ids, return_counts=True)
            grams, word, _ = _events(found.distinct())
            begin = np.searchsorted(word, np.arange(len(found.values) + 1))
            for k, name in enumerate(names):
                here = both // max(1, len(found.values)) == k
                weight = np.zeros(len(found.values), np.int64)
                weight[both[here] % max(1, len(found.values))] = seen[here]
                each = np.repeat(weight, np.diff(begin))
                some = np.flatnonzero(each)
                _, first, back = np.unique(_hash(grams[some]), return_index=True, return_inverse=True)
                total = np.bincount(back, each[some], len(first)).astype(np.int64)
                rows = grams[some[first]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array(rows[:, i]) for i in range(ORDER)), pa.array(total)], names=["lang", *(f"c{i}" for i in range(ORDER)), "n"])

    given = docs.where(F.col("lang").isNotNull() & ~tb.held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"))
    columns = [f"c{i}" for i in range(ORDER)]
    counted = given.mapInArrow(run, f"lang string, {', '.join(f'{c} int' for c in columns)}, n long")
    return counted.groupBy("lang", *columns).agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    langs: list[str]
    #: By n-gram length 1..ORDER: sorted hashes, and a row of log-probabilities (a column a language).
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    #: By context length 1..ORDER - 1: sorted hashes, and a row of log back-off weights.
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    unseen: float = -12.0
    temperature: float = 1.0
    bounds: dict[str, float] = field(default_factory=dict)
    #: Broadcast (grams of lengths 3 up, contexts of lengths 2 up) by shard; without any, all is above.
    shards: list = field(default_factory=list)

    def _parts(self, grams: np.ndarray) -> Iterator[tuple[np.ndarray, tuple[list, list]]]:
        """(numbers of events, the arrays that score them): a shard's arrays are read when its turn comes, and not kept."""
        if not self.shards:
            yield np.arange(len(grams)), (self.grams, self.contexts)
            return
        of = _shard(grams[:, 2].astype(np.int64), grams[:, 3].astype(np.int64), len(self.shards))
        for number, sent in enumerate(self.shards):
            events = np.flatnonzero(of == number)
            if len(events):
                more, contexts = sent.load_from_path(sent._path) if getattr(sent, "_path", None) else sent.value
                yield events, (self.grams + more, self.contexts + contexts)

    def word_scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By word: summed log-probability by language, events, letters."""
        grams, word, letter = _events(words)
        sums = np.zeros((len(words), len(self.langs)))
        step = max(1, CELLS_AT_ONCE // max(1, len(self.langs)))
        for events, tables in self._parts(grams):
            for begin in range(0, len(events), step):  # in runs: a row of scores an event, for however many languages
                some = events[begin : begin + step]
                of = word[some]
                head = np.flatnonzero(np.diff(of, prepend=-1))
                sums[of[head]] += np.add.reduceat(self._event_scores(grams[some], *tables), head, axis=0, dtype=np.float64)
        begin = np.searchsorted(word, np.arange(len(words) + 1))
        letters = np.concatenate(([0], np.cumsum(letter)))
        return sums, np.diff(begin), letters[begin[1:]] - letters[begin[:-1]]

    def _event_scores(self, grams: np.ndarray, learned: list, contexts: list) -> np.ndarray:
        """By event: log-probability by language, from the longest suffix that was learned."""
        total = np.zeros((len(grams), len(self.langs)), np.float32)
        waiting, weight = np.arange(len(grams)), np.zeros((len(grams), len(self.langs)), np.float32)
        for size in range(ORDER, 0, -1):
            keys, rows = learned[size - 1]
            h = _hash(grams[waiting, ORDER - size :])
            at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            total[waiting[hit]] = weight[waiting[hit]] + rows[at[hit]]
            waiting = waiting[~hit]
            if not len(waiting):
                break
            if size > 1:
                keys, rows = contexts[size - 2]
                h = _hash(grams[waiting, ORDER - size : -1])
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                weight[waiting[hit]] += rows[at[hit]]
        total[waiting] = weight[waiting] + self.unseen
        return total

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: cross-entropy per event by language, events, letters."""
        found = tb.words(*tb.utf8(column))
        scores, events, letters = self.word_scores(found.distinct())
        n = tb.segment_sums(events[found.ids], found.first)
        h = np.column_stack([tb.segment_sums(scores[found.ids, k], found.first) for k in range(len(self.langs))]) if self.langs else np.zeros((len(n), 0))
        return -h / np.maximum(n, 1)[:, None], n, tb.segment_sums(letters[found.ids], found.first)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, probability, cross-entropy, accepted); ``und`` without a letter or a learned language."""
        h, n, letters = self.entropies(column)
        if not self.langs:
            return ["und"] * len(n), np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), bool)
        return self.decide(h, n, letters)

    def decide(self, h: np.ndarray, n: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """``predict`` from cross-entropies, events and letters."""
        best = h.argmin(1)
        p = self.probabilities(h, n)[np.arange(len(n)), best]
        least = h[np.arange(len(n)), best]
        und = letters == 0
        limit = np.array([self.bounds.get(x, np.inf) for x in self.langs])
        return ["und" if u else self.langs[k] for u, k in zip(und, best, strict=True)], np.where(und, 0.0, p), np.where(und, 0.0, least), ~und & (least <= limit[best])

    def probabilities(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = -(h - h.min(1, keepdims=True)) * (np.sqrt(np.maximum(n, 1)) * self.temperature)[:, None]
        e = np.exp(np.maximum(z, -60))
        return e / e.sum(1, keepdims=True)


def _shard(before, last, many: int):
    """The shard of an event whose last two letters before its own are given (arrays or columns of longs)."""
    return (before * 1_000_003 + last) % many


def _rows_of(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows' sorted hashes, a row each, each row's number)."""
    keys, first, back = np.unique(_hash(grams), return_index=True, return_inverse=True)
    return keys, grams[first], back


def _kneser_ney(langs: list[str], of: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> LanguageModel:
    """Interpolated Kneser-Ney of each language over the shared n-grams.

    Lower orders count distinct left extensions; each order has its absolute discount
    n1 / (n1 + 2 n2).  A lower-order row mixes as P(c | ctx) = max(N - D, 0) / N(ctx) + b(ctx) P(c | shorter).
    """
    model = LanguageModel(langs)
    many = len(langs)
    tables, held, weight, lang = [], grams, counts.astype(float), of
    for size in range(ORDER, 0, -1):
        keys, rows, back = _rows_of(held)
        n = np.zeros((len(keys), many))
        np.add.at(n, (back, lang), weight)
        tables.append((size, keys, rows, n))
        seen = np.argwhere(n > 0)
        held, lang, weight = rows[seen[:, 0], 1:], seen[:, 1], np.ones(len(seen))
    alphabet = max(2, len(tables[-1][1]) if len(tables) else 2)
    model.unseen = -float(np.log(100.0 * alphabet))
    below: tuple[np.ndarray, np.ndarray] | None = None
    for size, keys, rows, n in reversed(tables):
        ctx_keys, _, ctx = _rows_of(rows[:, :-1]) if size > 1 else (np.zeros(1, np.uint64), None, np.zeros(len(rows), np.int64))
        total, kinds = np.zeros((len(ctx_keys), many)), np.zeros((len(ctx_keys), many))
        np.add.at(total, ctx, n)
        np.add.at(kinds, ctx, n > 0)
        once, twice = (n == 1).sum(0), (n == 2).sum(0)
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
        backoff = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        if below is None:
            lower = np.full((len(rows), many), 1.0 / (100.0 * alphabet))
        else:
            at = np.searchsorted(below[0], _hash(rows[:, 1:]))
            lower = below[1][at]
        p = np.maximum(n - discount, 0) / np.maximum(total[ctx], 1) + backoff[ctx] * lower
        below = (keys, p)
        model.grams.append((keys, np.log(p).astype(np.float32)))
        if size > 1:
            model.contexts.append((ctx_keys, np.log(backoff).astype(np.float32)))
    return model


def _columns(size: int) -> list[str]:
    """Names of the last ``size`` code points of an n-gram."""
    return [f"c{i}" for i in range(ORDER - size, ORDER)]


def _each(many: int, element) -> Column:
    """An array with an element a language."""
    return F.array(*[element(i) for i in range(many)])


def _kept(rows: DataFrame, where: str) -> DataFrame:
    """Rows written once and read again."""
    rows.write.parquet(where)
    return rows.sparkSession.read.schema(rows.schema).parquet(where)


def _tabulate(langs: list[str], learned: DataFrame, folder: str) -> LanguageModel:
    """``_kneser_ney`` by aggregations and joins on the n-gram, as tables ``grams-k`` (letters, log p) and ``contexts-k``
    (letters, log back-off weight) of the folder, arrays with an element a language."""
    many = len(langs)
    n = lambda i: F.col("n")[i]
    held = learned.groupBy(*_columns(ORDER)).agg(_each(many, lambda i: F.coalesce(F.sum(F.when(F.col("lang") == langs[i], F.col("n"))), F.lit(0))).alias("n"))
    counts: dict[int, DataFrame] = {}
    for size in range(ORDER, 0, -1):
        counts[size] = _kept(held, f"{folder}/counts-{size}")
        if size > 1:
            held = counts[size].groupBy(*_columns(size - 1)).agg(_each(many, lambda i: F.count_if(n(i) > 0)).alias("n"))
    alphabet = max(2, counts[1].count())
    model = LanguageModel(langs, unseen=-float(np.log(100.0 * alphabet)))
    for size in range(1, ORDER + 1):
        rare = counts[size].agg(_each(many, lambda i: F.count_if(n(i) == 1)).alias("once"), _each(many, lambda i: F.count_if(n(i) == 2)).alias("twice")).first()
        discount = [min(0.9, max(0.1, a / max(a + 2 * b, 1))) for a, b in zip(rare.once, rare.twice, strict=True)]
        context = _columns(size)[:-1]
        sums = counts[size].groupBy(*context).agg(_each(many, lambda i: F.sum(n(i))).alias("total"), _each(many, lambda i: F.count_if(n(i) > 0)).alias("kinds"))
        back = _each(many, lambda i: F.when(F.col("total")[i] > 0, F.lit(discount[i]) * F.col("kinds")[i] / F.col("total")[i]).otherwise(F.lit(1.0)))
        contexts = _kept(sums.select(*context, "total", F.transform(back, lambda x: F.log(x)).alias("b")), f"{folder}/contexts-{size}")
        if size == 1:  # one row of totals, and the even share of every letter below
            both = counts[1].crossJoin(F.broadcast(contexts)).withColumn("lower", _each(many, lambda i: F.lit(model.unseen)))
        else:
            below = counts[size].sparkSession.read.parquet(f"{folder}/grams-{size - 1}").withColumnRenamed("p", "lower")
            both = counts[size].join(contexts, context).join(below, _columns(size - 1))
        p = _each(many, lambda i: F.log(F.greatest(n(i) - F.lit(discount[i]), F.lit(0.0)) / F.greatest(F.col("total")[i], F.lit(1)) + F.exp(F.col("b")[i] + F.col("lower")[i])))
        _kept(both.select(*_columns(size), p.alias("p")), f"{folder}/grams-{size}")
    return model


def _sorted(rows: pa.Table, names: list[str], many: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, a row of values each) of rows (letters, v)."""
    letters = np.column_stack([rows.column(c).to_numpy() for c in names]).astype(np.uint32) if rows.num_rows else np.zeros((0, len(names)), np.uint32)
    values = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, many)
    keys = _hash(letters)
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def _sharded(model: LanguageModel, spark, folder: str, cells: int, most: int) -> LanguageModel:
    """The tables' arrays: lengths that do not show both letters of a shard go with the model, the others with their shards."""
    many, most = len(model.langs), max(most, LEAST_SHARD)
    read = lambda name, value: spark.read.parquet(f"{folder}/{name}").withColumnRenamed(value, "v")
    model.grams = [_sorted(read(f"grams-{k}", "p").toArrow(), _columns(k), many) for k in (1, 2)]
    model.contexts = [_sorted(read("contexts-2", "b").toArrow(), _columns(2)[:-1], many)]
    fill = lambda names: [F.col(c) if c in names else F.lit(0).alias(c) for c in _columns(ORDER)]
    parts = [read(f"grams-{k}", "p").select(F.lit(k).alias("size"), F.lit(False).alias("context"), *fill(_columns(k)), "v") for k in range(3, ORDER + 1)]
    parts += [read(f"contexts-{k}", "b").select(F.lit(k).alias("size"), F.lit(True).alias("context"), *fill(_columns(k)[:-1]), "v") for k in range(3, ORDER + 1)]
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    number = lambda n: _shard(F.col("c2").cast("long"), F.col("c3").cast("long"), n)
    n = max(1, -(-2 * cells // most))
    for _ in range(4):  # n-grams of two frequent letters lie together
        largest = rows.where(f"size = {ORDER} AND NOT context").groupBy(number(n)).count().agg(F.max("count")).first()[0] or 0
        if largest * many <= most:
            break
        n *= 2
    rows.withColumn("shard", number(n)).repartition("shard").write.partitionBy("shard").parquet(f"{folder}/shards")
    stored = spark.read.parquet(f"{folder}/shards")
    for i in range(n):
        own = stored.where(F.col("shard") == i).toArrow()
        pick = lambda k, context: own.filter(pa.compute.and_(pa.compute.equal(own["size"], k), pa.compute.equal(own["context"], context)))  # noqa: B023, E731
        arrays = [[_sorted(pick(k, context), _columns(k)[:-1] if context else _columns(k), many) for k in range(3, ORDER + 1)] for context in (False, True)]
        model.shards.append(spark.sparkContext.broadcast(tuple(arrays)))
    return model


def fit(docs: DataFrame, model_cells: int = MODEL_CELLS, calibration_texts: int = CALIBRATION_TEXTS) -> LanguageModel:
    """Count over all documents that may be learned from, and calibrate on a bounded sample of the same
    documents.  Every n-gram counts: up to ``model_cells`` cells the arrays are made at once, beyond by aggregations and
    joins, and cut into shards of at most so many."""
    folder = tb.shared_dir(docs.sparkSession, "languages")
    learned = _kept(count_ngrams(docs), f"{folder}/learned")
    langs = sorted(r.lang for r in learned.select("lang").distinct().collect())
    if not langs:
        return LanguageModel([])
    cells = learned.select(*_columns(ORDER)).distinct().count() * len(langs)
    if cells > model_cells:
        model = _sharded(_tabulate(langs, learned, folder), docs.sparkSession, folder, cells, model_cells)
    else:
        rows = learned.toArrow()
        number = {name: i for i, name in enumerate(langs)}
        of = np.array([number[x] for x in rows.column("lang").to_pylist()])
        grams = np.column_stack([rows.column(c).to_numpy() for c in _columns(ORDER)]).astype(np.uint32)
        model = _kneser_ney(langs, of, grams, rows.column("n").to_numpy())
    _calibrate(model, docs, calibration_texts)
    return model


def _calibrate(model: LanguageModel, docs: DataFrame, n: int) -> None:
    """Temperature of least log-loss, and per language the bound mean + 6 deviations of its entropies."""
    known = docs.where(F.col("lang").isNotNull() & ~tb.held_out(F.col("doc_id"))).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text", SLICE_BYTES):
            h, events, letters = model.entropies(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(h.tolist(), pa.list_(pa.float64())), pa.array(events), pa.array(letters)], names=["lang", "h", "n", "letters"])

    ids = hashed_sample(known.select("doc_id"), n)
    some = known.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select("doc_id", "lang", "text")
    rows = some.mapInArrow(run, "lang string, h array<double>, n long, letters long").where("letters > 0").toArrow()
    if not rows.num_rows:
        return
    h, events = np.array(rows.column("h").to_pylist()), rows.column("n").to_numpy()
    true = np.array([model.langs.index(x) if x in model.langs else -1 for x in rows.column("lang").to_pylist()])
    h, events, true = h[true >= 0], events[true >= 0], true[true >= 0]
    losses = []
    for t in np.geomspace(0.05, 50, 25):
        model.temperature = float(t)
        losses.append((-np.log(model.probabilities(h, events)[np.arange(len(h)), true] + 1e-12).mean(), t))
    model.temperature = float(min(losses)[1])
    own = h[np.arange(len(h)), true]
    for k, name in enumerate(model.langs):
        if (some := own[true == k]).size:
            model.bounds[name] = float(some.mean() + 6 * some.std() + 0.5)


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, accepted) for each row; ``und`` for null texts and
    texts without a letter.  Ties go to the first language in order.  Narrow, without a shuffle."""
    schema = "doc_id long, lang_pred string, score double, cross_entropy double, accepted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text", SLICE_BYTES):
            lang, p, h, accepted = model.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(p), pa.array(h), pa.array(accepted)], names=["doc_id", "lang_pred", "score", "cross_entropy", "accepted"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, schema)
