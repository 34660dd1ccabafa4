"""What each order of filters removes, from one pass over the documents.

Five filters (A to E) can be applied in 120 orders. Every document has a mask of
the filters that it fails, and only the 32 masks of each part of the corpus are
counted. In a given order a mask's documents go at the first filter that is in
the mask. Orders that begin alike are neighbours in lexicographic order: those
with the same first j filters have the Lehmer ranks ``start .. start + (5-j)! - 1``.
So each mask's removal step covers a few rank intervals; its count is added at
an interval's start and taken off at its end, and a prefix sum over the ranks
gives what every step of every order removes.

The text itself is read once and is not shuffled: a row travels as its id, its
part, four flags and the SHA-256 of its text. Rows that share id, part and text
are added up before the shuffle, then those that share part and text, so a group
of copies arrives as one row for each part and task.

Defined results: null text counts as empty, null part as the empty string; E
fails a row whose text a row with a smaller id has, so a null id neither fails E
nor makes others fail, and repeated rows of the smallest id all pass it; a
document is good (toxic) if any of its label rows says so; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
MARKS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n", "good", "toxic")


def orders(filters: str = FILTERS) -> list[str]:
    """All orders; an order's place in the list is its Lehmer rank."""
    return ["".join(p) for p in permutations(filters)]


def intervals(mask: int, size: int = len(FILTERS)) -> list[tuple[int, int, int, int]]:
    """``(step, filter, start, end)``: the ranks, end exclusive, of the orders in which ``filter`` removes the documents of ``mask`` at ``step`` (from 1)."""
    found = []

    def extend(left: list[int], start: int, step: int) -> None:
        width = factorial(len(left) - 1)
        for k, f in enumerate(left):  # the k-th smallest of what is left: Lehmer digit k
            at = start + k * width
            if mask >> f & 1:
                found.append((step, f, at, at + width))
            else:
                extend(left[:k] + left[k + 1 :], at, step + 1)

    if mask:
        extend(list(range(size)), 0, 1)
    return found


def failures(text: Column) -> Column:
    """Bits of A to D (1, 2, 4, 8) that a text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    fails = (n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * F.length(text), text.rlike(MARKS))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic`` of every part and mask that occurs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), failures(text).alias("mask"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("same"))
    rows = rows.groupBy("id", "part", "mask", "same").agg(F.count(F.lit(1)).alias("n"))
    said = labels.groupBy(F.col("doc_id").alias("id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(said, "id", "left").select("id", "part", "mask", "same", "n", *[(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in COUNTS[1:]])
    known = F.col("id").isNotNull()
    none = [F.coalesce(F.sum(F.when(~known, F.col(c))), F.lit(0)) for c in COUNTS]
    of_part = rows.groupBy("same", "part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS], F.array(*none).alias("none"), F.min(F.when(known, F.struct("id", *COUNTS))).alias("low"))
    first = F.min("low.id").over(W.partitionBy("same"))  # a row for each part that has the text
    of_part = of_part.withColumn("first", first)
    here = F.col("low.id") == F.col("first")
    passing = [F.get("none", F.lit(k)) + F.when(here, F.col(f"low.{c}")).otherwise(0) for k, c in enumerate(COUNTS)]
    both = of_part.select("part", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), *[p.alias(c) for p, c in zip(passing, COUNTS, strict=True)]),
        F.struct((F.col("mask") + 16).alias("mask"), *[(F.col(c) - p).alias(c) for p, c in zip(passing, COUNTS, strict=True)]),
    )).alias("x")).select("part", "x.*")
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS]).where("n > 0")


def audit(counts: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``: one row for each part, order and step."""
    spark, size = counts.sparkSession, len(FILTERS)
    total = factorial(size)
    table = spark.createDataFrame([(m, *x) for m in range(1, 1 << size) for x in intervals(m)], "mask int, step int, filter int, start int, end int")  # under 1,000 rows
    bit = lambda m, f: F.shiftright(m, f).bitwiseAND(F.lit(1)) == 1
    parts = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.coalesce(F.sum(F.when(bit(F.col("mask"), f), F.col("n"))), F.lit(0)) for f in range(size)]).alias("fails"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == 1 << f, F.col("n"))), F.lit(0)) for f in range(size)]).alias("unique"))
    changes = counts.join(F.broadcast(table), "mask").select("part", "step", F.explode(F.array(
        F.struct(F.col("start").alias("rank"), *[F.col(c).alias(c) for c in COUNTS]),
        F.struct(F.col("end").alias("rank"), *[(-F.col(c)).alias(c) for c in COUNTS]),
    )).alias("x")).select("part", "step", "x.*")
    zero = [F.lit(0).cast("long").alias(c) for c in COUNTS]
    empty = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("rank"), *zero)
    diff = changes.unionByName(empty).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in COUNTS])
    along = W.partitionBy("part", "step").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    names = F.array(*[F.lit(o) for o in orders()])
    removed = diff.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in COUNTS]).where(F.col("rank") < total)
    removed = removed.withColumn("filter_order", F.get(names, F.col("rank"))).withColumn("filter", F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1)
    so_far = F.sum("n").over(W.partitionBy("part", "rank").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    r = removed.withColumn("gone", so_far).withColumn("shapley", F.sum("n").over(W.partitionBy("part", "filter")))  # 600 rows for each part
    return r.join(parts, "part").select(
        "part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), F.col("n").alias("removed"), (F.get("fails", F.col("filter")) - F.col("n")).alias("redundant"),
        F.get("unique", F.col("filter")).alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
