"""Quality rules: counts of words, symbols and repeats, and a linear-chain CRF over lines.

The CRF labels each line that has a word as content or boilerplate from binned measures of the line;
its weights are fitted on a bounded sample of labelled texts (lines of bad texts start as boilerplate
and are relabelled by the model itself; repeats of an earlier line are boilerplate).  Viterbi decoding
runs over all texts of a slice at once, one line position a step.  A text stays if its content lines
hold at least a given share of its word characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbatch as tb
from tidemark.llm.calibrate import labelled_ids, labelled_texts

#: Bounds of the fit: labelled texts of each class, and characters of a text that may enter it.
SAMPLE_TEXTS, SAMPLE_CHARS = 1200, 20_000
#: Least share of word characters in content lines.
CONTENT_SHARE = 0.5
#: Least words, and most percent of words in repeated windows, of a text that passes the base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
CONTENT, BOILERPLATE = 0, 1

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_EXCLAIM = np.zeros(256, bool)
_EXCLAIM[33] = True

#: Bin edges of each measure of a line.
BINS = {
    "words": [1.5, 3.5, 8.5, 20.5, 60.5],
    "symbols": [1e-9, 0.02, 0.06, 0.12, 0.3],
    "upper": [1e-9, 0.05, 0.15, 0.4, 0.8],
    "digits": [1e-9, 0.05, 0.2, 0.5],
    "exclaims": [1e-9, 0.03, 0.1],
    "repeats": [1e-9, 0.05, 0.2, 0.5],
    "word_length": [2.5, 3.5, 4.5, 6.5, 9.5],
    "duplicate": [0.5],
}
N_FEATURES = sum(len(x) + 1 for x in BINS.values())


@dataclass
class Lines:
    """Base counts of a slice of texts, and the lines with a word: their bins, word characters and texts."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    bins: np.ndarray  # by line: a feature number for each measure
    chars: np.ndarray  # by line: word characters
    first: np.ndarray  # by text: its first line; one more entry than texts
    duplicate: np.ndarray  # by line: equal to an earlier line of its text


def _repeat_words(words: tb.Pieces) -> np.ndarray:
    """By text: words in 3-word windows that the text has twice or more."""
    n = len(words.ids)
    if n < 3:
        return np.zeros(len(words.first) - 1, np.int64)
    ids = words.ids.astype(np.int64)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    inside = doc[2:] == doc[:-2]
    if len(words.values) < 1 << 21:
        key = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:
        _, pair = np.unique(ids[:-1] * len(words.values) + ids[1:], return_inverse=True)
        key = pair[:-1] * len(words.values) + ids[2:]
    at = np.flatnonzero(inside)
    key, of = key[at], doc[at]
    mixed = (key.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(mixed)
    same = mixed[order[1:]] == mixed[order[:-1]]
    if same.any() and not ((key[order[1:]] == key[order[:-1]]) & (of[order[1:]] == of[order[:-1]]))[same].all():
        order = np.lexsort((key, of))  # two windows share a mixed key: sort by the windows themselves
        same = (key[order[1:]] == key[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    begin = at[twice]
    for i in range(3):
        covered[begin + i] = True
    return words.sums(covered)


def measure(column: pa.Array) -> Lines:
    """Counts and line bins of all texts (null: empty)."""
    data, offsets = tb.utf8(column)
    words = tb.words(data, offsets)
    solid = ~tb.SPACE[data]
    lead = (data & 0xC0) != 0x80
    newline = data == 10
    at = np.flatnonzero(newline)
    in_doc = np.searchsorted(at, offsets)
    n_texts = len(offsets) - 1
    begins = np.sort(np.concatenate((offsets[:-1], at + 1)), kind="stable")  # every text has a line more than newlines
    line_first = in_doc[:-1] + np.arange(n_texts)
    line_first = np.append(line_first, len(begins))
    ends = np.append(begins[1:], len(data)) if len(begins) else begins
    total = lambda flag: np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    between = lambda flag: (t := total(flag))[ends] - t[begins]
    chars = between(solid & lead)
    with_word = chars > 0
    kept = ~newline
    before = total(kept)
    pieces = tb.Pieces(data[kept], before[begins], line_first)
    doc = np.repeat(np.arange(n_texts), np.diff(line_first))
    _, head = np.unique(doc * max(1, len(pieces.values)) + pieces.ids, return_index=True)
    again = np.ones(len(begins), bool)
    again[head] = False
    again &= with_word
    solid_bytes = np.maximum(between(solid), 1)
    n_words = np.zeros(len(begins), np.int64)
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[heads] = solid[heads]
    n_words = between(starts)
    where = np.flatnonzero(starts)
    like_last = np.zeros(len(data), bool)
    if len(where) > 1:
        like_last[where[1:][words.ids[1:] == words.ids[:-1]]] = True
        like_last[where[np.minimum(words.first[:-1], len(where) - 1)]] = False
    letters = np.maximum(between(_UPPER[data]) + between(_LOWER[data]), 1)
    measures = {
        "words": n_words,
        "symbols": between(_SYMBOL[data]) / solid_bytes,
        "upper": between(_UPPER[data]) / letters,
        "digits": between(_DIGIT[data]) / solid_bytes,
        "exclaims": between(_EXCLAIM[data]) / solid_bytes,
        "repeats": between(like_last) / np.maximum(n_words, 1),
        "word_length": chars / np.maximum(n_words, 1),
        "duplicate": again,
    }
    at_feature, bins = 0, []
    for name, edges in BINS.items():
        bins.append(at_feature + np.searchsorted(edges, measures[name][with_word]))
        at_feature += len(edges) + 1
    of_text = lambda flag: (t := total(flag))[offsets[1:]] - t[offsets[:-1]]
    kept_before = total(with_word)
    dup_before = total(again)
    return Lines(
        n_words=np.diff(words.first),
        word_chars=of_text(solid & lead),
        n_symbols=of_text(_SYMBOL[data]),
        n_dup_lines=dup_before[line_first[1:]] - dup_before[line_first[:-1]],
        n_repeat_words=_repeat_words(words),
        bins=np.column_stack(bins) if bins else np.zeros((0, len(BINS)), np.int64),
        chars=chars[with_word],
        first=kept_before[line_first],
        duplicate=again[with_word],
    )


@dataclass
class LineCRF:
    """Weights: a row a label of feature weights, start weights, and transitions [from, to]."""

    weights: np.ndarray
    start: np.ndarray
    move: np.ndarray

    def emissions(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[:, bins].sum(-1).T if len(bins) else np.zeros((0, 2))

    def decode(self, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
        """By line: its label on its text's best path (ties: content), by Viterbi decoding."""
        e = self.emissions(bins)
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        active = np.searchsorted(-size[order], 0, side="left")  # texts with a line
        docs = order[:active]
        back, label = np.zeros((len(e), 2), np.int8), np.zeros(len(e), np.int64)
        best = self.start + e[first[docs]]
        longest = int(size.max()) if len(size) else 0
        final = best.copy()
        for t in range(1, longest):
            docs = docs[: np.searchsorted(-size[docs], -t, side="left")]  # those with a line t
            come = best[: len(docs), :, None] + self.move
            line = first[docs] + t
            back[line] = come.argmax(1)
            best = come.max(1) + e[line]
            final[: len(docs)] = best
        docs = order[:active]
        now = final.argmax(1)
        at = np.zeros(len(size), np.int64)
        at[docs] = now
        for t in range(longest - 1, -1, -1):
            live = docs[: np.searchsorted(-size[docs], -t, side="left")]
            line = first[live] + t
            label[line] = at[live]
            at[live] = back[line, at[live]]
        return label


def _marginals(crf: LineCRF, bins: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected labels by line, by first line of a text, and expected transitions, by forward-backward."""
    e = crf.emissions(bins)
    size = np.diff(first)
    docs = np.argsort(-size, kind="stable")
    docs = docs[size[docs] > 0]
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    forward[first[docs]] = crf.start + e[first[docs]]
    longest = int(size.max()) if len(size) else 0
    live = [docs[: np.searchsorted(-size[docs], -t, side="left")] for t in range(longest)]
    for t in range(1, longest):
        line = first[live[t]] + t
        forward[line] = np.logaddexp.reduce(forward[line - 1][:, :, None] + crf.move, axis=1) + e[line]
    for t in range(longest - 2, -1, -1):
        line = first[live[t + 1]] + t
        backward[line] = np.logaddexp.reduce(crf.move + (e[line + 1] + backward[line + 1])[:, None, :], axis=2)
    z = np.logaddexp.reduce(forward + backward, axis=1, keepdims=True)
    node = np.exp(forward + backward - z)
    follows = np.ones(len(e), bool)
    follows[first[docs]] = False
    line = np.flatnonzero(follows)
    edge = np.exp(forward[line - 1][:, :, None] + crf.move + (e[line] + backward[line])[:, None, :] - z[line][:, :, None])
    return node, node[first[docs]].sum(0), edge.sum(0)


def train(bins: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = 80, rate: float = 0.25, ridge: float = 1e-3) -> LineCRF:
    """Maximum likelihood by Adam steps from zero weights."""
    crf = LineCRF(np.zeros((2, N_FEATURES)), np.zeros(2), np.zeros((2, 2)))
    n = max(1, len(labels))
    hot = np.eye(2)[labels]
    heads = first[:-1][np.diff(first) > 0]
    follows = np.ones(len(labels), bool)
    follows[heads] = False
    later = np.flatnonzero(follows)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[later - 1], labels[later]), 1)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (crf.weights, crf.start, crf.move)]
    for step in range(1, steps + 1):
        node, start, edge = _marginals(crf, bins, first)
        lift = hot - node
        grad = np.zeros_like(crf.weights)
        for k in range(bins.shape[1]):
            for y in (0, 1):
                grad[y] += np.bincount(bins[:, k], lift[:, y], N_FEATURES)
        grads = (grad / n, (hot[heads].sum(0) - start) / n, (seen - edge) / n)
        for param, g, (m, v) in zip((crf.weights, crf.start, crf.move), grads, moments, strict=True):
            g = g - ridge * param
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            param += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return crf


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_TEXTS, rounds: int = 2) -> LineCRF:
    """Fit on a bounded sample of texts with a quality label, outside the held-out fifth.

    Without such texts all weights are zero, and every line is content."""
    # bounded: 2 * sample texts of at most SAMPLE_CHARS characters
    rows = labelled_texts(docs, labelled_ids(labels, "quality", sample, (0, 1)), SAMPLE_CHARS).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    texts, good = [r.text for r in rows], [r.y for r in rows]
    lines = measure(pa.array(texts, pa.string()))
    of = np.repeat(np.arange(len(texts)), np.diff(lines.first))
    bad_text = ~np.array(good, bool)
    labels_of = (bad_text[of] | lines.duplicate).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    crf = LineCRF(np.zeros((2, N_FEATURES)), np.zeros(2), np.zeros((2, 2)))
    if not len(labels_of) or not bad_text.any() or bad_text.all():
        return crf
    for turn in range(rounds):
        crf = train(lines.bins, lines.first, labels_of)
        if turn < rounds - 1:
            found = crf.decode(lines.bins, lines.first)
            some = np.bincount(of, found, len(texts)) > 0  # a bad text keeps a boilerplate line
            labels_of = np.where(bad_text[of], np.where(some[of], found, 1), lines.duplicate).astype(np.int64)
    return crf


def judge(docs: DataFrame, crf: LineCRF, doc_id: str = "doc_id", text: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """Counts and verdict for each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, content_share, kept.

    Null and empty texts count zero and fail the base rules; a text without a line with a word has
    content share 0.  Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text"):
            m = measure(batch.column(1))
            label = crf.decode(m.bins, m.first)
            content = tb.segment_sums(np.where(label == CONTENT, m.chars, 0), m.first)
            share = content / np.maximum(m.word_chars, 1)
            failed = (m.n_words < LEAST_WORDS) | (100 * m.n_repeat_words > MOST_REPEATED_PERCENT * m.n_words)
            columns = {"doc_id": batch.column(0), "n_words": m.n_words, "word_chars": m.word_chars, "n_symbols": m.n_symbols, "n_dup_lines": m.n_dup_lines, "n_repeat_words": m.n_repeat_words, "base_failed": failed, "content_share": share, "kept": ~failed & (share >= content_share)}
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")
