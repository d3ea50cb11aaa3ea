"""Phrase collocations by the stripes pattern: a prefix keys an associative counter of the words that follow it.

Texts become slices: runs of whole texts as arrays of word numbers, each piece apart.  Level by level a slice
makes its stripes (the empty prefix, one a language, then phrases of one word, of two, ...), and sends them
packed into blocks: a prefix key, the keys of its next words, their counts.  Blocks meet by ranges of prefixes,
where stripes of one prefix are merged elementwise: this gives the count of every extension.  A prefix whose total,
known from the level before, is large is dealt out over several ranges by its next words, so no range holds more than
its share.  Each block gets an answer back: a bit for each extension, whether it is frequent, the numbers of those, and
a bit for each of them that this slice is to report, so that every phrase is reported once, by the first slice that has it.
Only phrases whose prefix and rest are frequent go to the next level, which loses none that is frequent itself.

Words are known by 128 bits (two independent hashes, of the language and of the word); longer phrases exactly, by the
numbers that ranges give to frequent prefixes and words.  From the counts, again as stripes, come the counts of both parts
of each cut and the largest extension to either side, which decides whether a phrase is subsumed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textbatch as tb
from tidemark.operators.checkpoints import discard, kept

#: Extensions that a range of prefixes may hold; there are as many ranges as the words of all texts ask for.
RANGE_ENTRIES = 1 << 19
#: Occurrences of a prefix from which its stripe is dealt out over several ranges.
STRIPE_ENTRIES = 1 << 17
#: Candidates that one task ranks before the ranks of a language meet.
RANK_ROWS = 1 << 16
#: zstandard level of what is packed: slices and blocks are shuffled and written at every level.
PACK_LEVEL = 9

#: Bytes that end a piece, and bytes that separate its words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b"\x20\x09"
_BREAK, _GAP, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_BREAK[list(BREAKS)] = True
_GAP[list(BREAKS + BLANKS)] = True
_LOWER[0x41:0x5B] += 0x20

_STATE = "slice long, seq binary, grams binary, gid binary, spread binary, words binary, wid binary, of binary, langs array<string>, lang_n array<long>, phrase array<string>, phrase_of array<int>, f array<long>"
_CARRIED = ("slice", "seq", "grams", "gid", "spread", "words", "wid", "of", "langs", "lang_n")
_BLOCK = "slice long, r int, prefixes binary, widths binary, nexts binary, counts binary"
_ANSWER = "slice long, r int, kept binary, numbers binary, reported binary, told binary, totals binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of hashes."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _packed(values: np.ndarray, kind: str = "<i4") -> bytes:
    """Whole numbers by planes of bytes, compressed: most upper bytes are zero."""
    import zstandard

    raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, int(kind[-1])).T
    return zstandard.ZstdCompressor(level=PACK_LEVEL).compress(raw.tobytes())


def _unpacked(data: bytes, kind: str = "<i4") -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(int(kind[-1]), -1).T
    return np.ascontiguousarray(raw).view(kind)[:, 0].astype(np.int64) if raw.size else np.zeros(0, np.int64)


def _steps(ascending: np.ndarray) -> bytes:
    """Ascending numbers, packed by their differences."""
    return _packed(np.diff(ascending, prepend=ascending.dtype.type(0)), "<i8")


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<i8"))


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _hashes(words: list[bytes], seed: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def _row(number: int, seq, grams, gid, spread, words: list[bytes], wid, of, langs: list[str], lang_n, phrase: list[str] = (), phrase_of=(), f=()) -> pa.RecordBatch:
    import zstandard

    said = zstandard.ZstdCompressor(level=PACK_LEVEL).compress(b"\n".join(words))
    values = [number, _packed(seq), _packed(grams), _steps(gid), _packed(spread), said, _packed(wid, "<i8"), _packed(of), langs, lang_n, list(phrase), list(phrase_of), list(f)]
    kinds = [pa.int64(), *[pa.binary()] * 7, pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _STATE.split(", ")])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, lang) to slices: seq holds each word's type (a language and a word), -1 between pieces."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in tb.slices(batches, "text"):
        data, at = tb.utf8(batch.column(0))
        data = _LOWER[data]
        solid = ~_GAP[data]
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        heads = at[:-1][at[:-1] < at[1:]]
        start[heads] = solid[heads]
        begin = np.flatnonzero(start)
        if not len(begin):
            continue
        doc = np.searchsorted(at, begin, side="right") - 1
        piece = np.cumsum(_BREAK[data], dtype=np.int64)[begin]
        first = np.ones(len(begin), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1])
        words = tb.Pieces(data[solid], np.cumsum(solid, dtype=np.int64)[begin] - 1, np.searchsorted(begin, at))
        langs = pc.fill_null(batch.column(1).cast(pa.string()), "und").dictionary_encode()
        names = langs.dictionary.to_pylist()
        lang = langs.indices.to_numpy(zero_copy_only=False)[doc].astype(np.int64)
        types, seen, n = np.unique(lang * len(words.values) + words.ids, return_inverse=True, return_counts=True)
        of, which = np.divmod(types, len(words.values))
        common = np.argsort(-n, kind="stable")  # small numbers for the common ones
        rank = np.empty(len(n), np.int64)
        rank[common] = np.arange(len(n))
        seq = np.full(len(begin) + int(first.sum()), -1, np.int64)
        seq[np.arange(len(begin)) + np.cumsum(first)] = rank[seen]
        said = words.distinct()
        none = np.zeros(0, np.int64)
        yield _row(number, seq, none, none, none, [said[i] for i in which[common].tolist()], none, of[common], names, np.bincount(lang, minlength=len(names)).tolist())
        number += 1


class _Slice:
    """A slice at a level: seq holds the number of the frequent phrase that begins at a word, or -1."""

    def __init__(self, row: dict, level: int, ranges: int):
        import zstandard

        self.row, self.number, self.level = row, row["slice"], level
        self.seq, self.of, self.wid = _unpacked(row["seq"]), _unpacked(row["of"]), _unpacked(row["wid"], "<i8")
        self.words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b"\n") if len(self.of) else []
        if level == 1:  # the stripe of each language's empty prefix is dealt over all ranges
            self.left = np.arange(len(self.words))
            self.n = np.bincount(self.seq[self.seq >= 0], minlength=len(self.words))
            self.prefix = _hashes([x.encode() for x in row["langs"]], 1).view(np.int64)[self.of]
            self.next = _hashes(self.words, 2).view(np.int64)
            spread = np.full(len(self.words), ranges, np.int64)
        else:
            self.grams = _unpacked(row["grams"]).reshape(-1, level - 1)
            self.both = np.flatnonzero((self.seq[:-1] >= 0) & (self.seq[1:] >= 0))
            pair, self.which, self.n = np.unique(self.seq[self.both] * len(self.grams) + self.seq[self.both + 1], return_inverse=True, return_counts=True)
            self.left, self.right = np.divmod(pair, max(len(self.grams), 1))
            self.prefix, self.next = _from_steps(row["gid"])[self.left], self.wid[self.grams[self.right, -1]]
            spread = _unpacked(row["spread"])[self.left]
        r = ((_mix(self.prefix) >> np.uint64(1)) + _mix(self.next) % spread.astype(np.uint64)) % np.uint64(ranges)
        self.order = np.lexsort((self.next, self.prefix, r))
        self.range = r[self.order].astype(np.int64)

    def blocks(self) -> pa.RecordBatch:
        """The slice's stripes, a row for each range of prefixes that it has words in."""
        prefix, following, n = self.prefix[self.order], self.next[self.order], self.n[self.order]
        edge = np.flatnonzero(np.diff(self.range, prepend=-1, append=-1)) if len(n) else np.zeros(0, np.int64)
        rows = []
        for begin, end in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = prefix[begin:end]
            head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            widths = np.diff(head, append=end - begin)
            rows.append((self.number, int(self.range[begin]), _steps(own[head]), _packed(widths), _packed(following[begin:end], "<i8"), _packed(n[begin:end])))
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], names=names)

    def answered(self, answers: list[dict], last: bool) -> pa.RecordBatch | None:
        """The slice at the next level; None if no phrase of it is frequent."""
        answers = sorted(answers, key=lambda a: a["r"])
        size = dict(zip(*np.unique(self.range, return_counts=True), strict=True))
        kept, number, reported, total = [], [], [], []
        for a in answers:
            kept.append(_flags(a["kept"], int(size[a["r"]])))
            number.append(_from_steps(a["numbers"]))
            reported.append(_flags(a["reported"], len(number[-1])))
            total.append(np.zeros(len(number[-1]), np.int64))
            total[-1][_flags(a["told"], len(number[-1]))] = _unpacked(a["totals"], "<i8")
        kept, number, reported, total = map(np.concatenate, (kept, number, reported, total))
        stay, gid = self.order[kept], (self.range[kept] << 32) | number
        if not len(stay):
            return None
        left = self.left[stay]
        numbers = np.full(len(self.prefix), -1, np.int64)
        numbers[stay] = np.arange(len(stay))
        if self.level == 1:
            grams = left[:, None]
            seq = np.where(self.seq >= 0, numbers[self.seq], -1)
        else:
            grams = np.column_stack([self.grams[left], self.grams[self.right[stay], -1]])
            seq = np.full(len(self.seq), -1, np.int64)
            seq[self.both] = numbers[self.which]
        of = self.of[grams[reported, 0]]
        phrase = [b" ".join([self.words[w] for w in g]).decode() for g in grams[reported].tolist()]
        used, place = np.unique(grams, return_inverse=True)
        seq = seq[(seq >= 0) | (np.concatenate(([-1], seq[:-1])) >= 0)]
        none = np.zeros(0, np.int64)
        if last:
            carried = (none, none, none, none, [], none, none)
        else:
            wid = gid[np.argsort(left)] if self.level == 1 else self.wid[used]
            carried = (seq, place, gid, np.maximum(-(-total // STRIPE_ENTRIES), 1), [self.words[i] for i in used.tolist()], wid, self.of[used])
        return _row(self.number, *carried, self.row["langs"], self.row["lang_n"], phrase, of.tolist(), total[reported].tolist())


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def _merged(least: int):
    """Of a range, all blocks: stripes of one prefix are added elementwise; each block learns which extensions are frequent."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("slice")  # so that the same slice reports a phrase whenever this runs again
        columns = {c: table.column(c).to_pylist() for c in ("slice", "r", "prefixes", "widths", "nexts", "counts")}
        width = [_unpacked(x) for x in columns["widths"]]
        prefix = np.concatenate([np.repeat(_from_steps(p), w) for p, w in zip(columns["prefixes"], width, strict=True)])
        following = np.concatenate([_unpacked(x, "<i8") for x in columns["nexts"]])
        n = np.concatenate([_unpacked(x) for x in columns["counts"]])
        order = np.lexsort((following, prefix))
        new = np.ones(len(order), bool)
        new[1:] = (prefix[order][1:] != prefix[order][:-1]) | (following[order][1:] != following[order][:-1])
        sums = np.add.reduceat(n[order], np.flatnonzero(new))
        place, first = np.empty(len(order), np.int64), np.zeros(len(order), bool)
        place[order], first[order] = np.cumsum(new) - 1, new
        total, number = sums[place], (np.cumsum(sums >= least) - 1)[place]
        ends = np.cumsum([int(w.sum()) for w in width]).tolist()
        out = []
        for begin, end in zip([0, *ends[:-1]], ends, strict=True):
            kept = total[begin:end] >= least
            own, reported = total[begin:end][kept], first[begin:end][kept]
            told = reported | (own > STRIPE_ENTRIES)
            out.append((_bits(kept), _steps(number[begin:end][kept]), _bits(reported), _bits(told), _packed(own[told], "<i8")))
        made = [pa.array([x[i] for x in out], pa.binary()) for i in range(5)]
        return pa.table([pa.array(columns["slice"], pa.int64()), pa.array(columns["r"], pa.int32()), *made], names=[c.split()[0] for c in _ANSWER.split(", ")])

    return run


def _extend(slices: DataFrame, level: int, ranges: int, least: int, last: bool) -> DataFrame:
    """The slices one level on: stripes out by range, answers back by slice."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield _Slice(row, level, ranges).blocks()
            tb.give_back()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                made = _Slice(row, level, ranges).answered(row["answers"], last)
                if made is not None:
                    yield made
            tb.give_back()

    answers = slices.select(*_CARRIED).mapInArrow(send, _BLOCK).groupBy("r").applyInArrow(_merged(least), _ANSWER)
    back = answers.groupBy("slice").agg(F.collect_list(F.struct("r", "kept", "numbers", "reported", "told", "totals")).alias("answers"))  # a bit for each extension of a slice
    return slices.select(*_CARRIED).join(back, "slice").mapInArrow(take, _STATE)


def phrase_counts(docs: DataFrame, least: int = 100, most_words: int = 5, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all phrases of up to ``most_words`` words with f >= least, (lang, n): all words of each language)."""
    spark = docs.sparkSession
    out = tb.shared_dir(spark, "phrases")
    given = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    given.mapInArrow(_cut, _STATE).write.parquet(f"{out}/0")
    words = spark.read.schema(_STATE).parquet(f"{out}/0")
    of_lang = kept(words.select(F.inline(F.arrays_zip("langs", "lang_n"))).groupBy(F.col("langs").alias("lang")).agg(F.sum("lang_n").alias("n")), "words-of-langs")
    ranges = max(1, -(-(of_lang.agg(F.sum("n")).first()[0] or 0) // RANGE_ENTRIES))
    found = []
    for level in range(1, most_words + 1):
        before = spark.read.schema(_STATE).parquet(f"{out}/{level - 1}")
        _extend(before, level, ranges, least, level == most_words).write.parquet(f"{out}/{level}")
        discard(spark, f"{out}/{level - 1}")  # slices live for one level; what they report is kept by itself
        each = spark.read.schema(_STATE).parquet(f"{out}/{level}").select("langs", F.inline(F.arrays_zip("phrase", "phrase_of", "f")))
        found.append(kept(each.select(F.col("langs")[F.col("phrase_of")].alias("lang"), "phrase", "f"), "phrases-of-level"))
    discard(spark, f"{out}/{most_words}")
    return reduce(DataFrame.unionByName, found), of_lang


def collocations(docs: DataFrame, least: int = 100, most_words: int = 5, top: int = 2000, covered: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the ``top`` phrases of 2 to ``most_words`` words.

    a counts the phrase, n all words of the language.  Each cut of a phrase into two parts scores floor(1000 * a * n / (l * r));
    the least counts, ties to the first cut.  A phrase that lies in a longer one of at least ``covered`` per cent of its count
    is left out; since counts fall with length it is enough to look one word to either side.  Order: score and a descending,
    phrase ascending by its bytes; no two rows of a language tie.  Null texts count as empty, a null language is ``und``,
    repeated rows count as often as they stand; an empty table, or one without a frequent phrase, gives no row.
    Numbers are decimals of 38 digits, exact for up to 10 ** 16 words a language; beyond that the query fails.
    """
    spark = docs.sparkSession
    counts, of_lang = phrase_counts(docs, least, most_words, text, lang)
    out = tb.shared_dir(spark, "phrase-counts")
    counts.withColumn("k", F.size(F.split("phrase", " "))).write.parquet(f"{out}/f")
    of_lang.write.parquet(f"{out}/n")
    f = spark.read.schema("lang string, phrase string, f long, k int").parquet(f"{out}/f")
    n = spark.read.schema("lang string, n long").parquet(f"{out}/n")
    part = lambda a, b: F.array_join(F.slice(F.split("phrase", " "), a, b), " ")
    longer = f.where("k > 2").select("lang", "f", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = f.where("k > 1").join(most, ["lang", "phrase"], "left").where(F.coalesce(F.col("most") * 100 < F.col("f") * covered, F.lit(True)))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k")
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    both = cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(n, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    above = (F.lit(1000).cast("decimal(4,0)") * whole("a")).cast("decimal(19,0)") * whole("n")
    scored = both.withColumn("above", above).withColumn("below", whole("l") * whole("r")).withColumn("score", F.expr("above div below"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    parts = max(1, -(-f.where("k > 1").count() // RANK_ROWS))  # first the best of so many parts of a language, then of what these leave
    if parts > 1:
        part_of = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        best = best.withColumn("nth", F.row_number().over(Window.partitionBy("lang", part_of).orderBy(*order))).where(F.col("nth") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
