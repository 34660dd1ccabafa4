"""The nearest of many things for each of many points, by descent of a tree of boxes.

No step meets all pairs: every step is an equi-join of points with the boxes they still have
to look into, and boxes that cannot hold the nearest thing are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtide.session import checkpointed, settled

#: The finest grid has 2**BITS cells a side; a step down the tree takes STEP bits (4**STEP children).
BITS, STEP = 24, 2
#: Things that a box holds undivided.
LEAF = 32
#: A level of at most so many bytes is broadcast; points then meet it where they are.
BROADCAST_BYTES = 1 << 26
#: Points of a task; each looks into many boxes, so tasks are smaller than their bytes suggest.
TASK_POINTS = 1 << 14
BOX = ("box_x0", "box_y0", "box_x1", "box_y1")

Cost = Callable[[Callable[[str], Column]], Column]


def _cell(bits: int) -> Column:
    """A box of the grid with ``bits`` bits a side, as one number (unique among boxes of the same depth)."""
    return F.shiftright("at_x", BITS - bits) * F.lit(1 << BITS) + F.shiftright("at_y", BITS - bits)


def box_tree(things: DataFrame, order: list[str], leaf: int = LEAF) -> tuple[list[DataFrame], DataFrame]:
    """The levels of a tree over ``things`` and the things with their leaf.

    ``things`` has the columns of ``BOX`` and ``part``; a thing belongs to the box of its
    centre. Boxes of more than ``leaf`` things are split further, so a crowded place gets
    more levels and an empty one none; of a box of the finest grid ``chunks`` tells how many leaves' worth it holds. A level has ``part, parent, node, is_leaf``, the box around all of its
    things and ``pick``, one of them (the first by ``order``). Things without a box are left out.
    """
    inside = things.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in BOX]))
    cx, cy = (F.col(BOX[0]) + F.col(BOX[2])) / 2, (F.col(BOX[1]) + F.col(BOX[3])) / 2
    x0, y0, x1, y1 = inside.agg(F.min(cx), F.min(cy), F.max(cx), F.max(cy)).first()
    side = max((x1 or 0.0) - (x0 or 0.0), (y1 or 0.0) - (y0 or 0.0)) or 1.0
    place = lambda c, low: F.least(F.lit((1 << BITS) - 1), F.floor((c - (low or 0.0)) / side * (1 << BITS))).cast("long")
    rest = checkpointed(inside.select("*", place(cx, x0).alias("at_x"), place(cy, y0).alias("at_y")))
    levels, done = [], []
    for bits in range(0, BITS + 1, STEP):
        here = rest.withColumn("node", _cell(bits)).withColumn("parent", _cell(max(0, bits - STEP)))
        box = [f(c).alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max), strict=True)]
        facts = [c for c in things.columns if c not in (*BOX, "part")]
        pick = F.min_by(F.struct(*facts), F.struct(*order)).alias("pick")
        level = here.groupBy("part", "parent", "node").agg(F.count(F.lit(1)).alias("n"), *box, pick)
        level = settled(level.withColumn("is_leaf", (F.col("n") <= leaf) | F.lit(bits == BITS)))
        width = 8 * (12 + len(facts))
        levels.append((F.broadcast if level.count() <= BROADCAST_BYTES // width else lambda df: df)(level.drop("n")))
        keys = level.select("part", "node", "is_leaf", F.ceil(F.col("n") / leaf).alias("chunks"))
        here = here.drop("parent").join(keys, ["part", "node"])
        done.append(here.where("is_leaf").select(*things.columns, "node", F.lit(bits).alias("depth"), "chunks"))
        if level.where("not is_leaf").isEmpty():
            break
        rest = here.where("not is_leaf").drop("node", "is_leaf", "chunks")
    return levels, reduce(DataFrame.unionByName, done)


def nearest(points: DataFrame, things: DataFrame, cost: Cost, low: Callable[[Column, Column, Column, Column], Column], order: list[str], high: Callable[[Column, Column, Column, Column], Column] | None = None, leaf: int = LEAF) -> DataFrame:
    """``points`` with the thing of least cost in the same ``part``: columns ``cost`` and ``found`` (a struct of the thing).

    ``points`` has ``part``, what costs are made of and what else is to be handed on; ``things``
    has ``part`` and the columns of ``BOX``. ``cost`` takes a function from the name of a
    thing's column to that column; a null cost means that the two do not go together.
    ``low`` gives the least cost that anything in a box can have (null: nothing in it goes
    with the point), ``high`` the most that the best of the box can cost (null: unknown).
    Ties go to the first thing by ``order``, whose columns are unique in a part. Points
    for which nothing has a cost have no row. Things with the same box are best reduced
    to one beforehand: boxes of the finest grid are not split.
    """
    levels, leaves = box_tree(things, order, leaf)
    facts, box = [c for c in things.columns if c not in (*BOX, "part")], [F.col(c) for c in BOX]
    entries = checkpointed(points.withColumn("_point", F.monotonically_increasing_id()))
    entries = entries.repartition(max(1, -(-entries.count() // TASK_POINTS)), "_point")
    entries = entries.join(levels[0].select("part", F.lit(-1).cast("long").alias("node"), F.lit(False).alias("is_leaf")), "part")
    entries = entries.select("*", F.lit(0).alias("depth"), F.lit(0.0).alias("low"), F.lit(None).cast("double").alias("bound"))
    within = F.col("bound").isNull() | (F.col("low") <= F.col("bound") * (1 + 1e-9))
    for step, level in enumerate(levels):
        below = level.select(F.col("part").alias("in_part"), (F.lit(-1).cast("long") if step == 0 else F.col("parent")).alias("parent"), F.col("node").alias("child"), F.col("is_leaf").alias("child_leaf"), *BOX, "pick")
        # one join keeps the leaves found so far and opens the other boxes
        e = entries.join(below, (F.col("part") == F.col("in_part")) & (F.col("node") == F.col("parent")) & ~F.col("is_leaf"), "left")
        opened = F.col("child").isNotNull()
        # a box beyond the bound so far cannot lower it either, so it goes before the entries of a point meet
        # explode, so that the bound is worked out once and not again for every filter on it
        lows = F.explode(F.array(F.when(opened, low(*box).cast("double")).otherwise(F.col("low")))).alias("low")
        e = e.select(*[c for c in e.columns if c != "low"], lows).where("low is not null").where(within)
        best = F.least("bound", cost(lambda c: F.col("pick")[c]), *([] if high is None else [high(*box)])).cast("double")
        e = e.withColumn("bound", F.when(opened, best).otherwise(F.col("bound"))).withColumn("depth", F.when(opened, step * STEP).otherwise(F.col("depth")))
        e = e.withColumn("node", F.coalesce("child", "node")).withColumn("is_leaf", F.coalesce("child_leaf", "is_leaf")).select(*entries.columns)
        entries = e.withColumn("bound", F.min("bound").over(W.partitionBy("_point"))).where(within)
    # the things of a leaf travel as one array, so that of each entry only its best thing goes on
    chunk = F.pmod(F.xxhash64(*order), F.col("chunks"))
    leaves = leaves.groupBy("part", "node", "depth", chunk.alias("chunk")).agg(F.collect_list(F.struct(*facts)).alias("things"))
    pairs = entries.drop("low", "bound", "is_leaf").join(leaves.drop("chunk").hint("merge"), ["part", "node", "depth"])
    costs = F.transform("things", lambda t, i: F.struct(cost(lambda c: t[c]).alias("cost"), *[t[c].alias(c) for c in order], i.alias("_at")))
    pairs = pairs.withColumn("key", F.array_min(F.filter(costs, lambda k: k["cost"].isNotNull()))).where("key is not null")
    pairs = pairs.withColumn("thing", F.col("things")[F.col("key._at")]).drop("things")
    best = pairs.groupBy("_point").agg(*[F.first(c).alias(c) for c in points.columns], F.min("key.cost").alias("cost"), F.min_by("thing", F.struct("key.cost", *[F.col("key")[c].alias(c) for c in order])).alias("found"))
    return best.select(*points.columns, "cost", "found")


def box_gap(x: Column, y: Column) -> Callable[[Column, Column, Column, Column], Column]:
    """Distance of a point to the nearest place of a box, for :func:`nearest`."""
    side = lambda v, a, b: F.greatest(a - v, v - b, F.lit(0.0))
    return lambda x0, y0, x1, y1: F.hypot(side(x, x0, x1), side(y, y0, y1))


def box_reach(x: Column, y: Column) -> Callable[[Column, Column, Column, Column], Column]:
    """Distance of a point to the farthest place of a box."""
    return lambda x0, y0, x1, y1: F.hypot(F.greatest(F.abs(x - x0), F.abs(x - x1)), F.greatest(F.abs(y - y0), F.abs(y - y1)))
