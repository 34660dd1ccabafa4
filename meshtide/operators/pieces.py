"""Groups too large for one task, cut into pieces along their order, and what one piece hands on to the next."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtide.session import checkpointed

#: Rows of a group up to which it stays whole.
GROUP_ROWS = 1 << 20
#: Most groups that are cut (their keys are broadcast) and most cuts; with more rows the pieces grow instead.
MOST_GROUPS, MOST_CUTS = 100_000, 4_096


def cut(rows: DataFrame, key: str, order: str, group_rows: int = GROUP_ROWS) -> DataFrame | None:
    """``rows`` with ``_long`` (true in a group of more than ``group_rows`` rows, else null) and ``_piece``; None if no group is that long.

    The pieces of a long group follow ``order`` (a number, date or timestamp; groups in
    another order stay whole). Cuts are quantiles over the rows of all long groups, so a
    piece holds few of them however a group's rows lie; rows of one group with equal
    ``order`` share a piece. Null orders come first, NaN last, as in a sort.
    """
    kind = dict(rows.dtypes)[order]
    if kind in ("string", "boolean", "binary") or kind.startswith(("array", "struct", "map")):
        return None
    sizes = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    total, most = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    limit = max(group_rows, total // MOST_GROUPS)
    if most <= limit:
        return None
    long = checkpointed(sizes.where(F.col("_n") > limit).select("_key", F.lit(True).alias("_long"), "_n"))
    rows_of_long = long.agg(F.sum("_n")).first()[0]
    at = (F.unix_date(order) if kind == "date" else F.col(order)).cast("double")
    marked = rows.withColumn("_at", at).join(F.broadcast(long.drop("_n")), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    n = min(MOST_CUTS, 2 * -(-rows_of_long // limit))
    ends = marked.where("_long and not isnan(_at)").agg(F.percentile_approx("_at", [k / n for k in range(1, n)], 20 * n)).first()[0]
    splits = [float("-inf"), *sorted({x for x in ends or [] if abs(x) != float("inf")}), float("inf")]
    if len(splits) < 3:
        return marked.withColumn("_piece", F.when(F.col("_long") & F.col("_at").isNull(), -1).otherwise(0)).drop("_at")
    marked = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket", handleInvalid="keep").transform(marked)
    piece = F.when(F.col("_long") & F.col("_at").isNull(), -1).when(F.col("_long"), F.col("_bucket").cast("int")).otherwise(0)
    return marked.withColumn("_piece", piece).drop("_at", "_bucket")


def last_known(rows: DataFrame, key: str, order: str, wanted: dict[str, tuple[Column, bool]], then: Column | None = None, backwards: bool = False) -> DataFrame:
    """Adds for each name the last value that is not null of its Column, up to the row itself (True) or up to the one before (False).

    Rows follow ``order``, then ``then`` (a number); ``backwards`` goes from the last
    ``order`` to the first. Rows that :func:`cut` has marked are taken piece by piece: a
    piece is reduced to the last value of each name, these are carried on from piece to
    piece (one row for each), and enter the next one as a row before all others. So a
    long group is worked on by many tasks, and rows are shuffled once.
    """
    by = [F.col(order).desc() if backwards else F.col(order).asc()] + ([] if then is None else [then])
    upto = {name: 0 if own else -1 for name, (_, own) in wanted.items()}
    if "_piece" not in rows.columns:
        w = W.partitionBy(key).orderBy(*by)
        return rows.select("*", *[F.last(e, True).over(w.rowsBetween(W.unboundedPreceding, upto[n])).alias(n) for n, (e, _) in wanted.items()])
    marked = rows.select("*", F.lit(1).alias("_turn"), *[e.alias(f"_v_{n}") for n, (e, _) in wanted.items()])
    tie = F.lit(0) if then is None else then
    place, pick = (F.struct(F.col(order), -tie), F.min_by) if backwards else (F.struct(F.col(order), tie), F.max_by)
    ends = marked.where("_long").groupBy(key, "_piece").agg(*[pick(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_v_{n}") for n in wanted])
    before = W.partitionBy(key).orderBy(F.desc("_piece") if backwards else F.col("_piece")).rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(key, "_piece", F.lit(0).alias("_turn"), *[F.last(f"_v_{n}", True).over(before).alias(f"_v_{n}") for n in wanted])
    w = W.partitionBy(key, "_piece").orderBy("_turn", *by)
    both = marked.unionByName(carry, allowMissingColumns=True)
    out = both.select("*", *[F.last(f"_v_{n}", True).over(w.rowsBetween(W.unboundedPreceding, upto[n])).alias(n) for n in wanted])
    return out.where("_turn = 1").drop("_turn", *[f"_v_{n}" for n in wanted])


def grouped_percentiles(values: DataFrame, by: str, probabilities: tuple[float, ...], group_rows: int = GROUP_ROWS) -> DataFrame:
    """``by, p``: exact percentiles (linear between neighbours) of ``values(by, v)`` for groups of any size; nulls take no part.

    Equal values are counted first. Of each group only the pieces that hold a wanted
    position are put in order; the others are but counted.
    """
    counted = values.where("v is not null").groupBy(by, "v").agg(F.count(F.lit(1)).alias("n"))
    parts = cut(counted, by, "v", group_rows)
    if parts is None:
        parts = counted.withColumn("_piece", F.lit(0))
    group, along = W.partitionBy(by), W.partitionBy(by).orderBy("_piece")
    size = parts.groupBy(by, "_piece").agg(F.sum("n").alias("rows"))
    size = size.withColumn("total", F.sum("rows").over(group)).withColumn("below", F.sum("rows").over(along) - F.col("rows"))
    at = [(F.col("total") - 1) * p for p in probabilities]
    holds = [(F.col("below") <= k) & (k < F.col("below") + F.col("rows")) for a in at for k in (F.floor(a), F.ceil(a))]
    some = holds[0]
    for h in holds[1:]:
        some = some | h
    needed = size.where(some).select(F.col(by).alias("_by"), F.col("_piece").alias("_p"), "below", "total")
    rows = parts.join(needed, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_piece") == F.col("_p")))
    rows = rows.withColumn("upto", F.col("below") + F.sum("n").over(W.partitionBy(by, "_piece").orderBy("v")))
    ends = [F.min(F.when(F.col("upto") > f(a), F.col("v"))).alias(f"{side}{i}") for i, a in enumerate(at) for side, f in (("a", F.floor), ("b", F.ceil))]
    found = rows.groupBy(by).agg(F.first("total").alias("total"), *ends)
    between = [F.when(F.ceil(a) == F.floor(a), F.col(f"a{i}")).otherwise((F.ceil(a) - a) * F.col(f"a{i}") + (a - F.floor(a)) * F.col(f"b{i}")) for i, a in enumerate(at)]
    return found.select(by, F.array(*between).alias("p"))
