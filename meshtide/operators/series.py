"""Time-series jobs: checks, interpolation, hysteresis, summaries, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtide.operators.pieces import GROUP_ROWS, cut, last_known


def in_pieces(rows: DataFrame, key: str, order: str, group_rows: int) -> DataFrame:
    """``rows`` with series of more than ``group_rows`` rows cut into pieces of time, or as they are where there are none."""
    parts = cut(rows, key, order, group_rows)
    return rows if parts is None else parts


def interpolate_at(samples: DataFrame, queries: DataFrame, extrapolation: str = "hold", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``series_id, t, value``: linear between the samples around each query time.

    ``samples(series_id, t, value)``, ``queries(series_id, t)``; before the first
    and after the last sample the value is held, or null for
    ``extrapolation='error'``. Samples with null values take no part; of repeated
    times the largest value counts; a series without samples gives null. A series
    of more than ``group_rows`` rows is worked on by many tasks.
    """
    s = samples.where("value is not null and t is not null").groupBy("series_id", "t").agg(F.max("value").alias("value"))
    rows = s.select("series_id", "t", F.struct("t", "value").alias("s"), F.lit(0).alias("q")).unionByName(queries.select("series_id", "t", F.lit(None).cast(s.select(F.struct("t", "value").alias("s")).schema["s"].dataType).alias("s"), F.lit(1).alias("q")))
    rows = last_known(in_pieces(rows, "series_id", "t", group_rows), "series_id", "t", {"a": (F.col("s"), True)}, F.col("q"))
    rows = last_known(rows, "series_id", "t", {"b": (F.col("s"), True)}, F.col("q"), backwards=True).where("q = 1")
    t, a, b = F.col("t"), F.col("a"), F.col("b")
    mid = F.when(a["t"] == b["t"], a["value"]).otherwise(a["value"] + (b["value"] - a["value"]) * (t - a["t"]) / (b["t"] - a["t"]))
    return rows.select("series_id", "t", (F.coalesce(mid, a["value"], b["value"]) if extrapolation == "hold" else mid).alias("value"))


def hysteresis(depths: DataFrame, wet: float = 1e-3, dry: float = 5e-4, key: str = "cell", order: str = "step", value: str = "h", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds ``wet`` (0/1), ``newly_wet`` and ``newly_dry``: wet at or above ``wet``, dry at or below ``dry``, unchanged between; dry at first.

    A cell of more than ``group_rows`` rows is worked on by many tasks: a piece of its time hands on the last depth that decided.
    """
    decisive = F.when(F.col(value) >= wet, 1).when(F.col(value) <= dry, 0)
    wanted = {"wet": (decisive, True), "_was": (decisive, False), "_any": (F.lit(1), False)}
    rows = last_known(in_pieces(depths, key, order, group_rows), key, order, wanted)
    was = F.when(F.col("_any").isNotNull(), F.coalesce("_was", F.lit(0)))
    rows = rows.withColumn("wet", F.coalesce("wet", F.lit(0)))
    rows = rows.withColumn("newly_wet", F.coalesce((was == 0) & (F.col("wet") == 1), F.lit(False))).withColumn("newly_dry", F.coalesce((was == 1) & (F.col("wet") == 0), F.lit(False)))
    return rows.drop("_was", "_any", "_piece", "_long")


def regularised(rows: DataFrame, reference_depth: float = 1e-3, max_speed: float = 2.0) -> DataFrame:
    """Velocities of ``rows(..., h, hu, hv, area, wet)``: dry cells zeroed (their volume as ``removed``), speeds capped with direction kept."""
    deep = F.greatest(F.col("h"), F.lit(reference_depth))
    u, v = F.col("hu") / deep, F.col("hv") / deep
    s = F.sqrt(u * u + v * v)
    k = F.when(s > max_speed, max_speed / s).otherwise(1.0)
    on = F.col("wet") == 1
    return rows.select("*", F.when(on, u * k).otherwise(0.0).alias("u"), F.when(on, v * k).otherwise(0.0).alias("v"), F.when(on, F.col("h")).otherwise(0.0).alias("depth"), F.when(on, 0.0).otherwise(F.col("h") * F.col("area")).alias("removed"), (on & (s > max_speed)).alias("capped"))


def step_diagnostics(rows: DataFrame, reference_depth: float = 1e-3, wet: float = 1e-3, order: str = "step") -> DataFrame:
    """One row for each step of regularised ``rows(step, h, hu, hv, area, wet, newly_wet, newly_dry, u, v, removed, capped)``.

    Counts of wet, newly wet, newly dry and capped cells, the volume taken out of dry
    cells (``removed``) and the most that the wet threshold could take
    (``removable``), and the largest speeds of wet cells before and after the cap, 0 if no cell is wet.
    """
    on = F.col("wet") == 1
    before = F.sqrt(F.col("hu") * F.col("hu") + F.col("hv") * F.col("hv")) / F.greatest(F.col("h"), F.lit(reference_depth))
    after = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    top = lambda x: F.coalesce(F.max(F.when(on, x)), F.lit(0.0))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    return rows.groupBy(order).agg(
        F.count_if(on).alias("wet_cells"), F.count_if("newly_wet").alias("newly_wet"), F.count_if("newly_dry").alias("newly_dry"), F.count_if("capped").alias("capped"),
        total(F.col("removed")).alias("removed"), total(F.when(on, 0.0).otherwise(wet * F.col("area"))).alias("removable"), top(before).alias("speed_before"), top(after).alias("speed_after"))


def order_violations(series: DataFrame, least: int = 2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``series_id, n, violations, ok``: times that do not increase in input order (``ordinal``); too few samples are not ok."""
    rows = last_known(in_pieces(series, "series_id", "ordinal", group_rows), "series_id", "ordinal", {"_was": (F.struct("t"), False)})
    bad = F.coalesce(F.col("t") <= F.col("_was.t"), F.lit(False)) | F.col("t").isNull()
    r = rows.withColumn("bad", bad).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("violations"))
    return r.withColumn("ok", (F.col("violations") == 0) & (F.col("n") >= least))


def chunk_coverage(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """``kind, gaps, covered, complete`` for ``chunks(kind, start, count)`` against ``counts(kind, total)``."""
    w = W.partitionBy("kind").orderBy("start", "count")
    gap = F.col("start") != F.coalesce(F.lag(F.col("start") + F.col("count")).over(w), F.lit(0))
    r = chunks.withColumn("gap", gap).groupBy("kind").agg(F.count_if("gap").alias("gaps"), F.max(F.col("start") + F.col("count")).alias("covered"))
    return counts.select("kind", "total").join(r, "kind", "left").select("kind", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("covered", F.lit(0)).alias("covered"), (F.coalesce("gaps", F.lit(1)).eqNullSafe(0) & (F.col("covered") == F.col("total"))).alias("complete"))


def convergence_orders(levels: DataFrame, group: str = "group") -> DataFrame:
    """Observed order between neighbouring resolutions of ``levels(group, h, error)``; null unless both are positive and h decreases."""
    w = W.partitionBy(group).orderBy(F.desc("h"))
    h2, e2 = F.lead("h").over(w), F.lead("error").over(w)
    fine = (F.col("h") > h2) & (h2 > 0) & (F.col("error") > 0) & (e2 > 0)
    return levels.select(group, "h", "error", F.when(fine, F.log(F.col("error") / e2) / F.log(F.col("h") / h2)).alias("order"))


def series_summary(readings: DataFrame, key: str = "series_id") -> DataFrame:
    """Count, first and last time and a histogram of flags (``flags`` map, sorted by name) for ``readings(series_id, t, value, flag)``."""
    by_flag = readings.groupBy(key, F.coalesce("flag", F.lit("unspecified")).alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    return by_flag.groupBy(key).agg(F.sum("n").alias("n"), F.min("a").alias("first"), F.max("b").alias("last"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "n")))).alias("flags"))


# Fixed value: names of fields that hold a discharge.
DISCHARGE_FIELDS = "(?i)dsch|discharge|flow|流量"


def field_names(scalars: DataFrame, key: str = "id") -> DataFrame:
    """``id, fields, discharge_fields``: sorted distinct names, at every level, in the paths that :func:`web.flattened` gives.

    Names are counted once a key before they are put in a list. A name that holds a dot counts as several; places in arrays are no names.
    """
    name = F.explode(F.split(F.regexp_replace(F.regexp_replace("path", r"\[\d+\]", ""), r"^\$\.?", ""), r"\."))
    names = scalars.select(F.col(key), name.alias("name")).where("name <> ''").distinct()
    return names.groupBy(key).agg(F.array_sort(F.collect_list("name")).alias("fields")).withColumn("discharge_fields", F.filter("fields", lambda x: x.rlike(DISCHARGE_FIELDS)))


# Least score of each grade of a window, best first; below the last it is D.
GRADES = ((80, "A"), (65, "B"), (50, "C"))


def grade(score: Column) -> Column:
    """The letter of a window's score; null has none."""
    letter = F.when(score.isNotNull(), "D")
    for least, name in reversed(GRADES):
        letter = F.when(score >= least, name).otherwise(letter)
    return letter


def prime_windows(scores: DataFrame, now: Column | None = None, step: int = 1800, horizon: int = 86400) -> DataFrame:
    """Best, second and avoid windows of ``scores(series_id, t, score)`` (t in seconds, one row for each step).

    A centre's window score is 0.65 mean + 0.35 best of the scores at the centre
    and one step either side that exist, clamped to 0..100; ``second`` is the best
    window over 90 minutes away from the best (else the next best), ``avoid`` the
    lowest single score. ``now`` limits centres to the next ``horizon`` seconds.
    """
    if now is not None:
        centres = scores.where((F.col("t") >= now) & (F.col("t") <= now + horizon))
    else:
        centres = scores
    around = scores.select("series_id", F.explode(F.array(F.col("t") - step, F.col("t"), F.col("t") + step)).alias("t"), F.col("score").alias("near"))
    w = centres.select("series_id", "t", "score").join(around, ["series_id", "t"]).groupBy("series_id", "t").agg(F.first("score").alias("single"), F.avg("near").alias("mean"), F.max("near").alias("top"))
    w = w.withColumn("window", F.least(F.lit(100.0), F.greatest(F.lit(0.0), 0.65 * F.col("mean") + 0.35 * F.col("top"))))
    ranked = w.withColumn("ix", F.row_number().over(W.partitionBy("series_id").orderBy(F.desc("window"), "t")))
    best = ranked.where("ix = 1").select("series_id", F.col("t").alias("best_t"), F.col("window").alias("best_score"))
    others = ranked.where("ix > 1").join(best, "series_id").withColumn("far", F.abs(F.col("t") - F.col("best_t")) > 5400)
    second = others.groupBy("series_id").agg(F.min_by("t", F.struct((~F.col("far")).alias("a"), F.col("ix").alias("b"))).alias("second_t"))
    avoid = w.groupBy("series_id").agg(F.min_by("t", F.struct(F.col("single").alias("a"), F.col("t").alias("b"))).alias("avoid_t"))
    return best.join(second, "series_id", "left").join(avoid, "series_id", "left")


def with_parameter(rows: DataFrame, name: str, value: DataFrame | Column | float | None, extrapolation: str = "hold") -> DataFrame:
    """``rows(series_id, t, ...)`` with ``name`` from a number, a Column or samples ``(series_id, t, value)`` read at each row's time."""
    if not isinstance(value, DataFrame):
        return rows.withColumn(name, value if isinstance(value, Column) else F.lit(value))
    at = interpolate_at(value, rows.select("series_id", "t").distinct(), extrapolation).withColumnRenamed("value", name)
    at = at.withColumnsRenamed({"series_id": "_s", "t": "_t"})
    return rows.join(at, F.col("series_id").eqNullSafe(F.col("_s")) & F.col("t").eqNullSafe(F.col("_t")), "left").drop("_s", "_t")
