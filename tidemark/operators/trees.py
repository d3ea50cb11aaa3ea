"""Ancestry in histories and forests by labels: J18.

A commit's first parent makes a forest.  Every commit gets its depth and pointers 4 ** k steps up, in as many rounds as the
depth has digits of base 4; a pair is answered by climbing from the deeper tip by the digits of the difference, one
equi-join a digit.  Parents beyond the first are cross edges, and only pairs that the forest leaves open search over them, by
intervals: a node has its own pre-order number and the last one below it, and lies below another if its
number lies in the other's interval.  The labels of a forest take two runs of
pointer jumping (subtree sizes, then sums of offsets), each round four times as far as the one before, by a few equi-joins of
one row a node.  The merges above a commit are those whose intervals hold its number, found by dyadic cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.checkpoints import kept

#: Parts of a node's children that are numbered apart, so that no node's children meet in one task.
SIBLING_PARTS = 64


def _jumped(t: DataFrame, *carried: str) -> DataFrame:
    """Each row with the pointers of the three rows above it, and what they carry, as up1 .. up4."""
    out = t.withColumnsRenamed({"up": "up1", **{c: f"{c}1" for c in carried}})
    for i in (2, 3, 4):
        out = out.join(t.select(F.col("v").alias(f"up{i - 1}"), F.col("up").alias(f"up{i}"), *(F.col(c).alias(f"{c}{i}") for c in carried)), f"up{i - 1}", "left")
    return out


def jump_tables(parents: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """For forest rows (v, up), up null for a root: tables k of (v, up1, up2, up3), the nodes 1, 2 and 3 times 4 ** k steps
    up, and (v, depth).  A cycle is an error."""
    limit = max(parents.count(), 1).bit_length() // 2 + 2
    now, levels = parents.select("v", "up", F.col("up").isNotNull().cast("long").alias("depth")), []
    for _ in range(limit):
        if now.where("up IS NOT NULL").isEmpty():
            return levels, now.select("v", "depth")
        depth = sum((F.coalesce(f"depth{i}", F.lit(0)) for i in (2, 3, 4)), F.col("depth1"))
        far = kept(_jumped(now, "depth").select("v", "up1", "up2", "up3", F.col("up4").alias("up"), depth.alias("depth")), "jumps")
        levels.append(far.select("v", "up1", "up2", "up3"))
        now = far.select("v", "up", "depth")
    raise ValueError("the parents have a cycle")


def forest_labels(parents: DataFrame, stored: bool = False) -> DataFrame:
    """(v, root, pre, last) for forest rows (v, up); up is null for a root.  A cycle is an error.

    stored: the rows are a table already, so they are not written again."""
    rows = parents.select("v", "up") if stored else kept(parents.select("v", "up"), "forest")
    limit = max(rows.count(), 1).bit_length() // 2 + 2

    def sizes(t: DataFrame) -> DataFrame:
        far = _jumped(t.drop("size"), "top").select("v", F.col("up4").alias("up"), F.coalesce("top4", "top3", "top2", "top1").alias("top"), F.array("up1", "up2", "up3").alias("above"))
        held = far.join(t.select("v", "size"), "v")
        below = held.select(F.explode("above").alias("v"), "size").where("v IS NOT NULL").groupBy("v").agg(F.sum("size").alias("more"))
        return held.join(below, "v", "left").select("v", "up", "top", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))

    def sums(t: DataFrame) -> DataFrame:
        pre = sum((F.coalesce(f"pre{i}", F.lit(0)) for i in (2, 3, 4)), F.col("pre1"))
        return _jumped(t, "pre").select("v", F.col("up4").alias("up"), pre.alias("pre"))

    def settled(t: DataFrame, step) -> DataFrame:
        for _ in range(limit):
            t = kept(t, "jumps")
            if t.where("up IS NOT NULL").isEmpty():
                return t
            t = step(t)
        raise ValueError("the parents have a cycle")

    sized = settled(rows.select("v", "up", F.coalesce("up", "v").alias("top"), F.lit(1).cast("long").alias("size")), sizes)
    each = rows.join(sized.select("v", F.col("top").alias("root"), "size"), "v").withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SIBLING_PARTS)))
    each = kept(each, "sized")
    inner = Window.partitionBy("up", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("up").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = each.where("up IS NOT NULL").groupBy("up", "part").agg(F.sum("size").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(outer), F.lit(0))).drop("all")
    placed = each.where("up IS NOT NULL").withColumn("own", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(parts, ["up", "part"])
    offsets = placed.select("v", "up", (F.col("own") + F.col("before") + 1).alias("pre"))
    offsets = offsets.unionByName(each.where("up IS NULL").select("v", "up", F.lit(0).cast("long").alias("pre")))
    numbers = settled(offsets, sums).select("v", "pre")
    return numbers.join(each.select("v", "root", "size"), "v").select("v", "root", "pre", (F.col("pre") + F.col("size") - 1).alias("last"))


def cells_of(low: Column, high: Column, bits: int) -> Column:
    """The largest dyadic blocks that fill [low, high], as structs (level, block): at most two a level."""
    one = lambda j, x: F.array(F.struct(j.alias("level"), x.alias("block")))
    none = F.array().cast("array<struct<level:int,block:bigint>>")

    def step(acc: Column, j: Column) -> Column:
        low, high = acc["low"], acc["high"]
        left = (low <= high) & (low % 2 == 1)
        low2 = low + left.cast("long")
        right = (low2 <= high) & (high % 2 == 0)
        high2 = high - right.cast("long")
        cells = F.concat(acc["cells"], F.when(left, one(j, low)).otherwise(none), F.when(right, one(j, high)).otherwise(none))
        more = low2 <= high2
        return F.struct(F.when(more, F.shiftright(low2, 1)).otherwise(1).cast("long").alias("low"), F.when(more, F.shiftright(high2, 1)).otherwise(0).cast("long").alias("high"), cells.alias("cells"))

    start = F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), none.alias("cells"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits)), start, step, lambda acc: acc["cells"])


def cells_at(point: Column, bits: int) -> Column:
    """The blocks of every level that hold a point, as structs (level, block)."""
    return F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda j: F.struct(j.alias("level"), F.call_function("shiftright", point, j).alias("block")))


def ancestry(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(local, remote, direction) of commit pairs over parent edges (child, parent, optionally generation of the child).

    direction is local_ahead where remote is an ancestor of local, remote_ahead for the reverse; equal tips, unknown ones
    and tips without a common line give ``neither``.  A commit's first parent (the least, parents have no order here) makes the
    forest; most pairs are answered by climbing it.  The others search: each round finds all merges above what a side has
    reached, tests their other parents against the target's interval and goes on from those; answered sides stop.  Rounds
    follow how often lines alternate, not how long they are.  Where edges carry generation numbers (as a commit
    graph stores them), nothing below the target's is looked at.  Parents that form a cycle are an error.
    """
    known = edges.where("child IS NOT NULL AND parent IS NOT NULL AND child <> parent")
    numbered = "generation" in edges.columns
    nodes = known.select(F.col("child").alias("v"), F.col("parent").alias("up")).unionByName(known.select(F.col("parent").alias("v"), F.lit(None).cast(dict(known.dtypes)["parent"]).alias("up")))
    forest = nodes.groupBy("v").agg(F.min("up").alias("up"), F.max("up").alias("other"))
    forest = kept(forest, "parents")
    levels, depth = jump_tables(forest)
    start = pairs.select("local", "remote").distinct()
    of = lambda s: depth.select(F.col("v").alias(s), F.col("depth").alias(s[0]))
    tips = start.join(of("local"), "local", "left").join(of("remote"), "remote", "left")
    up = F.col("l") > F.col("r")
    climb = tips.select("local", "remote", F.when(up, F.col("local")).otherwise(F.col("remote")).alias("at"), F.when(up, F.col("remote")).otherwise(F.col("local")).alias("goal"), F.coalesce(F.abs(F.col("l") - F.col("r")), F.lit(0)).alias("rest"), up.alias("up"))
    for level in levels:
        digit = F.col("rest") % 4
        hop = F.when(digit == 0, F.col("at")).when(digit == 1, F.col("up1")).when(digit == 2, F.col("up2")).otherwise(F.col("up3"))
        climb = climb.join(level.withColumnRenamed("v", "at"), "at", "left").select("local", "remote", hop.alias("at"), "goal", F.floor(F.col("rest") / 4).alias("rest"), "up")
    found = (F.col("at") == F.col("goal")) & (F.col("local") != F.col("remote"))
    by_tree = climb.select("local", "remote", F.when(found, F.when(F.col("up"), "local_ahead").otherwise("remote_ahead")).alias("direction"))
    if not forest.where("up <> other").isEmpty():
        by_tree = kept(by_tree, "pairs")
        label = forest_labels(forest, stored=True)
        named = lambda s: label.select(F.col("v").alias(s), F.struct("root", "pre", "last").alias(s[0]))
        still = by_tree.where("direction IS NULL AND local <> remote").join(named("local"), "local").join(named("remote"), "remote")
        crossing = known.join(forest.where("up <> other").select(F.col("v").alias("child"), "up"), "child").where("parent <> up").select(*known.columns).distinct()
        met = _searched(still, crossing, label, known if numbered else None)
        by_tree = by_tree.join(met, ["local", "remote"], "left").withColumn("direction", F.coalesce("direction", "side"))
    return by_tree.select("local", "remote", F.coalesce("direction", F.lit("neither")).alias("direction"))


def _searched(open_pairs: DataFrame, crossing: DataFrame, label: DataFrame, generations: DataFrame | None) -> DataFrame:
    """(local, remote, side) of the pairs that cross edges connect."""
    m, p = (label.select(F.col("v").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("root", "pre", "last"))) for c in ("child", "parent"))
    bits = int((label.agg(F.max("last")).first()[0] or 0)).bit_length()
    merges = crossing.select("child", "parent").join(m, "child").join(p.drop("parent_last"), "parent")
    if generations is not None:
        level = generations.groupBy(F.col("child").alias("of")).agg(F.max("generation").alias("generation"))
        merges = merges.join(level.select(F.col("of").alias("parent"), F.col("generation").alias("height")), "parent", "left").withColumn("height", F.coalesce("height", F.lit(0)))
    else:
        merges = merges.withColumn("height", F.lit(0))
    cells = kept(merges.select("parent", "parent_root", "parent_pre", "height", F.col("child_root").alias("root"), F.explode(cells_of(F.col("child_pre"), F.col("child_last"), bits)).alias("cell")).select("*", "cell.*").drop("cell"), "cells")

    def sides(tip: str, goal: str, name: str) -> DataFrame:
        out = open_pairs.select("local", "remote", F.lit(name).alias("side"), F.col(f"{tip[0]}.root").alias("at_root"), F.col(f"{tip[0]}.pre").alias("at_pre"), F.col(goal[0]).alias("goal"))
        if generations is None:
            return out.withColumn("floor", F.lit(0))
        return out.join(level.select(F.col("of").alias(goal), F.col("generation").alias("floor")), goal, "left").withColumn("floor", F.coalesce("floor", F.lit(0)))

    both = sides("local", "remote", "local_ahead")
    now = kept(both.unionByName(sides("remote", "local", "remote_ahead").select(*both.columns)), "sides")
    key = ["local", "remote", "side"]
    seen, found = None, []
    while not now.isEmpty():
        points = now.select(*key, "goal", "floor", F.col("at_root").alias("root"), F.explode(cells_at(F.col("at_pre"), bits)).alias("cell")).select("*", "cell.*").drop("cell")
        reached = points.join(cells, ["root", "level", "block"]).where("height >= floor").groupBy(*key, "parent").agg(*(F.first(c).alias(c) for c in ("goal", "floor", "parent_root", "parent_pre")))
        if seen is not None:
            reached = reached.join(seen, [*key, "parent"], "left_anti")
        hit = (F.col("parent_root") == F.col("goal.root")) & F.col("parent_pre").between(F.col("goal.pre"), F.col("goal.last"))
        reached = kept(reached.withColumn("hit", hit), "reached")
        answered = reached.where("hit").select(*key).distinct()
        found.append(answered)
        now = reached.join(answered, key, "left_anti").select(*key, F.col("parent_root").alias("at_root"), F.col("parent_pre").alias("at_pre"), "goal", "floor")
        seen = reached.select(*key, "parent") if seen is None else kept(seen.unionByName(reached.select(*key, "parent")), "seen")
    out = None
    for one in found:
        out = one if out is None else out.unionByName(one)
    return out if out is not None else open_pairs.select("local", "remote", F.lit("").alias("side")).limit(0)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches; nodes with no edge to another are absent.

    Each round links every node's larger neighbours to its least one, then every node to the least of its smaller
    ones; edges never grow in number, and a table is written a round, until nothing changes."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = kept(pairs, "links"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        ways = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        outer = ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("to").alias("b")).distinct()
        inner = outer.groupBy("a").agg(F.min("b").alias("to"))
        moved = outer.join(inner, "a").where("b <> to").select(F.col("b").alias("a"), F.col("to").alias("b"))
        now = kept(moved.unionByName(inner.select("a", F.col("to").alias("b"))).distinct(), "links")
