"""Exact top-k search by distributed histogram selection.

Vectors are turned into whole numbers; the score of a query and a candidate is their inner product.  Queries go
to tasks in blocks of bounded size; every task scores all of its candidates against the block, and a global
histogram of the scores locates each query's kth value: the bin that holds it is refined, round after round, until
it is one value wide.  A last pass filters by that value; ties go to smaller ids.

A task reports of its own histogram only the bins from the top down to the one that holds its own kth value:
the global kth value lies no lower, so what is left out cannot matter, and a task sends at most k bins for a
query whatever its rows.  No score is stored, no candidate leaves its task before the filter, and nothing is
sampled or capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textbatch as tb

#: Components of the queries that go to tasks at once (8 bytes each).
BLOCK_COMPONENTS = 1 << 21
#: Queries that go to tasks at once.
BLOCK_QUERIES = 2048
#: Scores that a task holds at once.
SCORES_AT_ONCE = 1 << 21
#: Bins of a histogram, as a power of two.
BIN_BITS = 11
#: Range of a long: inner products beyond it count as its ends.
LEAST, MOST = 1 - (1 << 63), (1 << 63) - 1


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id long, v array<long>, copies long): floor(scale * x) of each component; equal rows once, with their number.

    Vectors that are null or hold a null or non-finite component are left out; an empty vector stays (its scores are 0)."""
    x = F.col("v")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    kept = given.where(x.isNotNull() & whole).select("vec_id", F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))
    return kept.groupBy("vec_id", "v").agg(F.count("*").alias("copies"))


class _Block:
    """A block of queries as a matrix, padded with zeros to its longest vector."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("vec_id").to_numpy()
        lists = rows.column("v").combine_chunks()
        self.lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        width = int(self.lengths.max(initial=0))
        self.matrix = np.zeros((len(self.ids), width), np.int64)
        self.matrix[np.arange(width) < self.lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        self.most = int(max(abs(int(self.matrix.max(initial=0))), abs(int(self.matrix.min(initial=0)))))
        self.by_id = np.argsort(self.ids, kind="stable")

    def bound(self, most_l1: int) -> int:
        """No score of these queries lies beyond it, given the largest sum of a candidate's sizes of components."""
        return min(self.most * most_l1, MOST)


def _runs(batch: pa.RecordBatch, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, copies, matrix) of candidates that have one length, at most ``at_once`` at a time."""
    lists = batch.column(batch.schema.get_field_index("v"))
    ids, copies = batch.column(batch.schema.get_field_index("vec_id")), batch.column(batch.schema.get_field_index("copies")).to_numpy()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for begin in range(0, len(rows), at_once):
            some = rows[begin : begin + at_once]
            flat = lists.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
            yield some, ids, copies[some], flat.reshape(len(some), int(n))


def _products(block: _Block, matrix: np.ndarray) -> np.ndarray:
    """Inner products, exact: in floats where no sum can pass their whole numbers, else in Python's own."""
    n = min(matrix.shape[1], block.matrix.shape[1])
    q, c = block.matrix[:, :n], matrix[:, :n]
    if not n or not len(c):
        return np.zeros((len(q), len(c)), np.int64)
    large = np.maximum(np.abs(c.max(1).astype(object)), np.abs(c.min(1).astype(object))).max()
    bound = block.most * int(large) * n
    if bound < 1 << 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, LEAST, MOST).astype(np.int64)


def _scores(block: _Block, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(scores, weights, ids) of every query against runs of candidates; a weight is the number of equal rows, less
    the query's own."""
    at_once = max(1, SCORES_AT_ONCE // max(len(block.ids), 1))
    sorted_ids = block.ids[block.by_id]
    for batch in batches:
        for rows, ids, copies, matrix in _runs(batch, at_once):
            scores = _products(block, matrix)
            weights = np.broadcast_to(copies, scores.shape).copy()
            some = ids.take(pa.array(rows))
            known = pc.fill_null(some, 0).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(sorted_ids, known), np.searchsorted(sorted_ids, known, side="right")
            usable = (high > low) & pc.is_valid(some).to_numpy(zero_copy_only=False)
            for j in np.flatnonzero(usable):
                for i in block.by_id[low[j] : high[j]]:
                    if block.lengths[i] == matrix.shape[1] and (block.matrix[i, : matrix.shape[1]] == matrix[j]).all():
                        weights[i, j] -= 1
            yield scores, weights, some


def _bins(table: DataFrame, block, low: list[int], shift: int, bins: int, k: int) -> DataFrame:
    """(query, bin, n): the histogram of scores from each query's low on, in bins of 2 ** shift values, tasks' tails left out."""
    first = np.array(low, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = block.value
        total = np.zeros((len(here.ids), bins), np.int64)
        floor = first.astype(np.int64)[:, None]
        for scores, weights, _ in _scores(here, batches):
            inside = (scores >= floor) & (weights > 0)
            where = (scores.astype(np.uint64) - floor.astype(np.uint64)) >> np.uint64(shift)
            inside &= where < bins
            place = (np.arange(len(here.ids))[:, None] * bins + where.astype(np.int64))[inside]
            each = weights[inside]
            made = np.bincount(place, None if (each == 1).all() else each, total.size)
            total += made.astype(np.int64).reshape(total.shape)
        above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
        query, which = np.nonzero((total > 0) & (above < k))
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(which), pa.array(total[query, which])], names=["query", "bin", "n"])

    made = table.mapInArrow(run, "query long, bin long, n long")
    return made.groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _kth(table: DataFrame, block, n: int, bound: int, k: int) -> list[int]:
    """Each query's kth score (its number of scores is counted with equal rows); the least possible where there are fewer."""
    width = (2 * bound + 1).bit_length()
    shift = max(0, width - BIN_BITS)
    low, above, bins = [max(-bound, LEAST)] * n, [0] * n, 1 << BIN_BITS
    while True:
        counted = _bins(table, block, low, shift, bins, k)
        before = F.coalesce(F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        seen = block.spark.createDataFrame(list(enumerate(above)), "query long, above long")
        hit = counted.withColumn("before", before).join(seen, "query").where((F.col("before") + F.col("above") < k) & (F.col("before") + F.col("above") + F.col("n") >= k))
        for r in hit.select("query", "bin", (F.col("before") + F.col("above")).alias("above")).collect():  # one row a query of the block
            low[r.query], above[r.query] = low[r.query] + (r.bin << shift), r.above
        if not shift:
            return low
        bins = 1 << min(BIN_BITS, shift)  # of the bin that holds the kth value
        shift = max(0, shift - BIN_BITS)


class _Sent:
    """A broadcast block with its session."""

    def __init__(self, spark, block: _Block):
        self.spark, self.sent = spark, spark.sparkContext.broadcast(block)

    @property
    def value(self) -> _Block:
        return self.sent.value

    def __getstate__(self):
        return {"spark": None, "sent": self.sent}


def _best(table: DataFrame, block, kth: list[int], k: int) -> DataFrame:
    """(query, vec_id, score, copies): rows above each query's kth score, and of those that equal it a task's k smallest ids."""
    floor_of = np.array(kth, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = block.value
        floor = floor_of.astype(np.int64)
        tied: list[pa.Table] = []
        names = ["query", "vec_id", "score", "copies"]

        def least() -> None:
            """Of the tied rows held, k a query: the smallest ids, null ids last."""
            held = pa.concat_tables(tied)
            order = pc.sort_indices(held, sort_keys=[("query", "ascending"), ("vec_id", "ascending")], null_placement="at_end")
            held = held.take(order)
            query = held.column("query").to_numpy()
            nth = np.arange(len(query)) - np.searchsorted(query, query)
            tied[:] = [held.filter(pa.array(nth < k))]

        for scores, weights, ids in _scores(here, batches):
            for equal in (False, True):
                query, row = np.nonzero(((scores == floor[:, None]) if equal else (scores > floor[:, None])) & (weights > 0))
                found = pa.table([pa.array(query), ids.take(pa.array(row)), pa.array(scores[query, row]), pa.array(weights[query, row])], names=names)
                if not equal:
                    yield from found.to_batches()
                elif len(query):
                    tied.append(found)
                    if sum(map(len, tied)) > SCORES_AT_ONCE // 4 + 2 * k * len(here.ids):
                        least()
        if tied:
            least()
            yield from tied[0].combine_chunks().to_batches()

    return table.mapInArrow(run, "query long, vec_id long, score long, copies long")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row that ``is_query`` (an expression over vec_id) picks, the k rows
    of highest score among all others, ties to smaller vec_id (null ids last); all of them where there are fewer.

    Vectors that are null or hold null or non-finite components take no part.  Of vectors of different lengths
    the shorter counts as continued by zeros.  Scores beyond a long count as its end.  Repeated rows are rows: each is a
    candidate for the others and, as a query, has its own k rows; a row with a null id is no query.  An empty table
    gives no row.
    """
    spark = vectors.sparkSession
    out = tb.shared_dir(spark, "vectors")
    whole_vectors(vectors, vec_id, vector, scale).write.parquet(out)  # read in every round
    table = spark.read.parquet(out)
    asked = table.where(F.col("vec_id").isNotNull() & is_query)
    size = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda s, c: (s + F.abs(c.cast("decimal(20,0)"))).cast("decimal(38,0)"))
    of_table = table.agg(F.max(size).alias("l1")).first()
    of_asked = asked.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("cells")).first()
    blocks = max(-(-of_asked.n // BLOCK_QUERIES), -(-(of_asked.cells or 0) // BLOCK_COMPONENTS))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "v", F.lit("block")), F.lit(max(blocks, 1))))
    found = f"{out}-found"
    schema = "query_id long, vec_id long, score long, copies long, query_copies long, block long, query long"
    spark.createDataFrame([], schema).write.parquet(found)
    for b in range(blocks):
        rows = numbered.where(F.col("block") == b).orderBy("vec_id", "v").toArrow()  # a block: bounded, whatever the table
        if not len(rows):
            continue
        sent = _Sent(spark, _Block(rows))
        kth = _kth(table, sent, len(rows), sent.value.bound(int(of_table.l1 or 0)), k)
        ids = rows.column("vec_id").to_pylist()
        names = spark.createDataFrame(list(zip(range(len(ids)), ids, rows.column("copies").to_pylist(), strict=True)), "query long, query_id long, query_copies long")
        best = _best(table, sent, kth, k).join(F.broadcast(names), "query").withColumn("block", F.lit(b).cast("long"))
        best.select(*(c.split()[0] for c in schema.split(", "))).write.mode("append").parquet(found)
        sent.sent.unpersist()
    each = spark.read.schema(schema).parquet(found).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))))
    order = Window.partitionBy("block", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    repeated = ranked.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("query_copies"))))
    return repeated.select("query_id", "rank", "vec_id", "score")
