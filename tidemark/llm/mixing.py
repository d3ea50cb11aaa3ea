"""Mixing sources to target sizes by entropy balancing, with DataFrame and SQL functions only.

Of all document rates r (0 to 2 copies), the ones nearest to 1 in relative entropy that give each
source its target words are r = min(2, exp(t size / its mean size)) with one tilt t a source: the dual is
convex, and Newton steps solve it for all sources at once.  Each step is an aggregation over the table
of (source, size) counts, which is made once, so a step costs what the distinct sizes cost.

Rates become whole copies in two parts.  Each (source, size) group gets a whole number of copies (its
exact number, rounded by a hash), and a few greedy passes over the groups close each source's gap.
Then a group's copies are dealt to its documents evenly: groups are split by a hash of doc_id into
blocks, copies go to blocks by running share, and inside a block by rank.  No source or group is ever
gathered in one task: only blocks are ranked, and everything else is a partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import textbatch as tb

#: Weights of the sources in code-point order, repeating; words shared out as a percent of all; copies at most.
WEIGHTS, SHARE_PERCENT, MOST_COPIES = (3, 1, 2), 150, 2
#: Blocks into which a group of documents of one source and size is split: so many at least, and one for so many documents of all.
LEAST_BLOCKS, ROWS_A_BLOCK = 256, 1 << 16
#: Newton steps before the solution counts as failed, steps in one job, and the gap to a target at which they
#: stop (relative, and in words).
NEWTON_STEPS, STEPS_A_JOB, GAP, GAP_WORDS = 80, 4, 1e-7, 1e-3
#: Fixed-point digits of the sums: whole numbers add up alike in any order, so reruns agree.
FIXED = 1_000_000
#: Sources up to which their table (a row a source) is broadcast; beyond it the joins shuffle.
BROADCAST_SOURCES = 100_000
#: Greedy passes that close the gap left by rounding.
CLOSING_PASSES = 6


def n_words(text: Column) -> Column:
    """Runs of characters outside the six ASCII white-space characters (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_copies: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, source_docs, target) from rows (source, size, docs).

    Sources in code-point order, null last, take the weights in turn.  A target stops at most_copies
    times its source's size, and the excess goes to the others by weight until none is above: the level (words a
    weight) rises by Newton steps from below, each one sum over the sources, until no further source is full.  Places are
    numbered within ranges of sources, so no task holds more than a range.  One row a source.
    """
    tb.use_checkpoints(sizes.sparkSession)
    per_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("source_docs"))
    by_name = F.col("source").asc_nulls_last()
    ranges = per_source.repartitionByRange(by_name).withColumn("range", F.spark_partition_id()).checkpoint()
    earlier = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    begins = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(earlier, F.lit(0)).alias("begin"))
    place = F.col("begin") + F.row_number().over(Window.partitionBy("range").orderBy(by_name)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = ranges.join(begins, "range").withColumn("place", place).withColumn("weight", weight)
    full = placed.select("source", "source_size", "source_docs", "weight", (F.lit(float(most_copies)) * F.col("source_size")).alias("limit")).checkpoint()
    size, open_weight = full.agg(F.sum("source_size"), F.sum("weight")).first()
    to_share, filled, level = share_percent / 100.0 * (size or 0), 0.0, -1.0
    while open_weight and (to_share - filled) / open_weight > level:
        level = (to_share - filled) / open_weight
        is_full = F.lit(level) * F.col("weight") >= F.col("limit")
        filled, open_weight = full.agg(F.coalesce(F.sum(F.when(is_full, F.col("limit"))), F.lit(0.0)), F.sum(F.when(~is_full, F.col("weight")))).first()
    target = F.least("limit", F.lit(level) * F.col("weight")) if open_weight else F.col("limit")
    return full.select("source", "source_size", "source_docs", target.alias("target"))


def _by_source(table: DataFrame, n_sources: int) -> DataFrame:
    """A table of one row a source, marked for broadcast where its counted rows are few."""
    return F.broadcast(table) if n_sources <= BROADCAST_SOURCES else table


def _rate(tilt: Column, z: Column, most_copies: int) -> Column:
    return F.least(F.lit(float(most_copies)), F.exp(F.least(tilt * z, F.lit(50.0))))


def _whole(x: Column) -> Column:
    """A number in fixed point, so that sums do not depend on their order."""
    return F.round(x * FIXED).cast("decimal(38,0)")


def solve_tilts(groups: DataFrame, targets: DataFrame, n_sources: int, most_copies: int = MOST_COPIES) -> DataFrame:
    """(source_key, tilt): the dual's solution by safeguarded Newton steps, one aggregation a step.

    groups: (source_key, size, docs, z), z > 0 where size > 0; targets: (source_key, target, limit).  With q
    the target's share of the source, the root lies between 0 and log(q) / least z, since there even the
    least size is tilted by q.  Each step keeps a bracket; a Newton step that leaves it becomes a bisection.
    A target at a source's limit has an unbounded tilt: its rate is the limit itself (no row).  Sources that
    do not meet their targets are an error, never a result.
    """
    data = groups.join(_by_source(targets, n_sources), "source_key").where("target > 0 AND target < limit AND size > 0").select("source_key", "z", (F.col("size") * F.col("docs")).cast("double").alias("mass"), "target").checkpoint()
    edge = F.log(F.first("target") / F.sum("mass")) / F.min("z")
    zero = F.lit(0.0)
    state = data.groupBy("source_key").agg(edge.alias("edge")).select("source_key", zero.alias("tilt"), F.least("edge", zero).alias("low"), F.greatest("edge", zero).alias("high"), F.lit(True).alias("open"))
    for step in range(1, NEWTON_STEPS + 1):
        rate = _rate(F.col("tilt"), F.col("z"), most_copies)
        slope = F.when(rate < most_copies, F.col("mass") * F.col("z") * rate).otherwise(0.0)
        sums = data.join(_by_source(state, n_sources), "source_key").groupBy("source_key").agg(F.sum(_whole(F.col("mass") * rate)).cast("double").alias("got"), F.sum(_whole(slope)).cast("double").alias("slope"), F.first("target").alias("target"), F.first("tilt").alias("tilt"), F.first("low").alias("low"), F.first("high").alias("high"))
        over = F.col("got") / FIXED - F.col("target")
        low, high = F.when(over < 0, F.col("tilt")).otherwise(F.col("low")), F.when(over >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(over, F.col("slope") / FIXED)
        moved = sums.select("source_key", "tilt", low.alias("low"), high.alias("high"), newton.alias("newton"), (F.abs(over) > F.greatest(F.lit(GAP) * F.col("target"), F.lit(GAP_WORDS))).alias("open"))
        inside = F.coalesce((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")), F.lit(False))
        state = moved.select("source_key", F.when(~F.col("open"), F.col("tilt")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2).alias("tilt"), "low", "high", "open")
        if step % STEPS_A_JOB == 0:
            state = state.checkpoint()
            if state.where("open").isEmpty():
                return state.select("source_key", "tilt")
    raise RuntimeError(f"{state.where('open').count()} sources have not met their targets after {NEWTON_STEPS} steps")


def group_copies(groups: DataFrame, targets: DataFrame, tilts: DataFrame, n_sources: int, most_copies: int = MOST_COPIES) -> DataFrame:
    """(source_key, size, docs, copies): whole copies of each group, near each source's target.

    Rounding takes the group's exact number up or down by a hash of the group; then, while a source is
    off target, the largest groups that still fit take or give copies, in passes over the groups, and
    at last the smallest group takes one step past the target if that comes nearer.  All passes are
    windows over a source's distinct sizes in one order, so they share one shuffle and one sort; no
    more rows of a source meet than it has distinct sizes.
    """
    rate = F.coalesce(_rate(F.col("tilt"), F.col("z"), most_copies), F.when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.lit(float(most_copies))))
    luck = F.pmod(F.xxhash64("source_key", "size", F.lit("round")), F.lit(1 << 20)).cast("double") / (1 << 20)
    exact = F.col("docs") * rate
    now = groups.join(_by_source(targets, n_sources), "source_key").join(_by_source(tilts, n_sources), "source_key", "left").select("source_key", "size", "docs", "target", F.when(F.col("size") == 0, F.col("docs")).otherwise(F.least(F.floor(exact + luck), F.col("docs") * most_copies)).cast("long").alias("copies"))
    source = Window.partitionBy("source_key").orderBy(F.col("size").desc())
    larger, all_of_it = source.rowsBetween(Window.unboundedPreceding, -1), source.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.round(F.col("target") - F.sum(F.col("size") * F.col("copies")).over(all_of_it)).cast("long")
    sign = F.sign("gap").cast("long")
    for _ in range(CLOSING_PASSES):
        now = now.withColumn("gap", gap)
        room = F.when(F.col("gap") > 0, F.col("docs") * most_copies - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("gap"))
        now = now.withColumn("room", F.when(fits, room).otherwise(F.lit(0)))
        now = now.withColumn("left", F.abs("gap") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(larger), F.lit(0)))
        moved = F.when(fits & (F.col("left") > 0), F.least(F.col("room"), F.floor(F.col("left") / F.col("size")))).otherwise(F.lit(0)).cast("long")
        now = now.select("source_key", "size", "docs", "target", (F.col("copies") + sign * moved).alias("copies"))
    # what is left is smaller than any group that fits: one step past the target where that is nearer
    now = now.withColumn("gap", gap)
    able = (F.col("size") > 0) & (F.col("size") < 2 * F.abs("gap")) & F.when(F.col("gap") > 0, F.col("copies") < F.col("docs") * most_copies).otherwise(F.col("copies") > 0)
    now = now.withColumn("step_size", F.min(F.when(able, F.col("size"))).over(all_of_it))
    step = F.when(F.col("size") == F.col("step_size"), sign).otherwise(F.lit(0))
    return now.select("source_key", "size", "docs", (F.col("copies") + step).alias("copies")).checkpoint()


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_copies: int = MOST_COPIES) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies.

    A null text has size 0, and texts of size 0 keep one copy (they take no words).  A null source is
    a source of its own.  Rows that repeat a doc_id are mixed each for itself; ties in rank between
    such rows do not change how many copies a block gets.  An empty table gives no row.
    """
    spark = docs.sparkSession
    tb.use_checkpoints(spark)
    key = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("null"))
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), key.alias("source_key"), n_words(F.col(text)).alias("size"))
    out = tb.shared_dir(spark, "mix-sizes")
    given.write.parquet(out)  # narrow rows, read by every later step; the texts are read once
    given = spark.read.parquet(out)
    n_blocks = max(LEAST_BLOCKS, given.count() // ROWS_A_BLOCK)
    block = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(n_blocks))
    blocks = given.groupBy("source", "source_key", "size", block.alias("block")).agg(F.count("*").alias("in_block"))
    sizes = blocks.groupBy("source", "source_key", "size").agg(F.sum("in_block").alias("docs")).checkpoint()
    targets = source_targets(sizes, weights, share_percent, most_copies)
    mean = F.col("source_size") / F.col("source_docs")
    targets = targets.select("source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("source_key"), "source_size", mean.alias("mean"), "target", (F.lit(float(most_copies)) * F.col("source_size")).alias("limit")).checkpoint()
    n_sources = targets.count()
    groups = sizes.join(_by_source(targets.select("source_key", "mean"), n_sources), "source_key").select("source_key", "size", "docs", F.coalesce(F.try_divide(F.col("size"), F.col("mean")), F.lit(0.0)).alias("z"))
    of_source = targets.select("source_key", "target", "limit")
    copies = group_copies(groups, of_source, solve_tilts(groups, of_source, n_sources, most_copies), n_sources, most_copies)
    # copies by block: the running share of the group's documents, so blocks add up to the group
    earlier = Window.partitionBy("source_key", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    dealt = blocks.select("source_key", "size", "block", "in_block").join(copies, ["source_key", "size"]).withColumn("upto", F.sum("in_block").over(earlier))
    share = lambda upto: F.floor(F.col("copies").cast("decimal(38,0)") * upto / F.col("docs")).cast("long")
    dealt = dealt.select("source_key", "size", "block", "in_block", (share(F.col("upto")) - share(F.col("upto") - F.col("in_block"))).alias("block_copies"))
    rank = F.row_number().over(Window.partitionBy("source_key", "size", "block").orderBy("doc_id"))
    each = given.withColumn("block", block).withColumn("rank", rank).join(dealt, ["source_key", "size", "block"])
    own = F.floor(F.col("block_copies") * F.col("rank") / F.col("in_block")) - F.floor(F.col("block_copies") * (F.col("rank") - 1) / F.col("in_block"))
    mixed = each.select("doc_id", "size", "source_key", own.cast("long").alias("copies"))
    return mixed.join(_by_source(targets, n_sources), "source_key").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it (0 times: gone).

    Rows that repeat a doc_id all get the most copies of them; rows with a null doc_id stay once."""
    copies = mix(docs.where(F.col(doc_id).isNotNull()), doc_id, text, source).groupBy("doc_id").agg(F.max("copies").alias("_copies")).withColumnRenamed("doc_id", "_mixed_id")
    joined = docs.join(copies, docs[doc_id] == copies["_mixed_id"], "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    again = joined.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return again.select(*[F.col(c) for c in docs.columns])
