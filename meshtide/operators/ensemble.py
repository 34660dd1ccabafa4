"""Statistics over ensembles of model fields: ``field(case_id, cell_id, depth, u, v)``."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtide.operators.pieces import grouped_percentiles
from meshtide.session import shared_dir, written

PROBABILITIES = (0.025, 0.25, 0.5, 0.75, 0.975)
NAMES = ("p025", "q1", "median", "q3", "p975")


@dataclass(frozen=True)
class Activity:
    """When a row has a direction: depth above ``wet`` (None: any) and speed above ``speed``; ``clip`` limits agreement to 0..1."""

    wet: float | None
    speed: float
    clip: bool = False


LENIENT, WET_4, WET_6 = Activity(None, 1e-9), Activity(1e-4, 1e-9), Activity(1e-6, 1e-6, True)


def speed() -> Column:
    return F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))


def active(profile: Activity) -> Column:
    a = speed() > profile.speed
    return a if profile.wet is None else a & (F.col("depth") > profile.wet)


#: Cases of a cell up to which one buffer holds its values.
CELL_ROWS = 1 << 16


def cell_statistics(field: DataFrame, profile: Activity = WET_6, dry: float = 1e-6, by: str = "cell_id", group_rows: int = CELL_ROWS) -> DataFrame:
    """One row for each cell: exact quantiles (linear between neighbours) of speed and depth, widths, wet probability, direction.

    Cells of up to ``group_rows`` cases take one shuffle and a buffer of their own
    values; of larger ones the values are counted in pieces, so memory does not grow
    with the cases. Null values take no part; a cell without active rows has a null
    direction, agreement 0 and support 0.
    """
    on = active(profile)
    means = [
        F.avg((F.col("depth") > dry).cast("double")).alias("wet_probability"), F.count(F.lit(1)).alias("cases"), F.count(F.when(on, 1)).alias("active"),
        F.avg(F.when(on, F.col("u") / speed())).alias("mu"), F.avg(F.when(on, F.col("v") / speed())).alias("mv")]
    whole = [F.percentile(x, F.array(*[F.lit(p) for p in PROBABILITIES])).alias(n) for x, n in ((speed(), "s"), (F.col("depth"), "d"))]
    sizes = field.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n"))
    if sizes.where(F.col("_n") > group_rows).isEmpty():
        rows = field.groupBy(by).agg(*whole, *means)
    else:
        sized = field.join(sizes, F.col(by).eqNullSafe(F.col("_by")))
        few, many = sized.where(F.col("_n") <= group_rows), sized.where(F.col("_n") > group_rows)
        large = many.groupBy(by).agg(*means)
        for x, n in ((speed(), "s"), (F.col("depth"), "d")):
            p = grouped_percentiles(many.select(by, x.alias("v")), by, PROBABILITIES, group_rows).select(F.col(by).alias("_of"), F.col("p").alias(n))
            large = large.join(p, F.col(by).eqNullSafe(F.col("_of")), "left").drop("_of")
        rows = few.groupBy(by).agg(*whole, *means).unionByName(large)
    length = F.coalesce(F.sqrt(F.col("mu") * F.col("mu") + F.col("mv") * F.col("mv")), F.lit(0.0))
    agreement = F.least(F.lit(1.0), length) if profile.clip else length
    q = [F.col(c)[k].alias(f"{name}_{n}") for c, name in (("s", "speed"), ("d", "depth")) for k, n in enumerate(NAMES)]
    widths = [(F.col(c)[3] - F.col(c)[1]).alias(f"{n}_iqr") for c, n in (("s", "speed"), ("d", "depth"))] + [(F.col(c)[4] - F.col(c)[0]).alias(f"{n}_p95_width") for c, n in (("s", "speed"), ("d", "depth"))]
    return rows.select(by, *q, *widths, "wet_probability", agreement.alias("agreement"), F.when(F.col("active") > 0, F.atan2("mv", "mu")).alias("direction"), "active", (F.col("active") / F.col("cases")).alias("support"), (F.col("active") >= 2).alias("eligible"))


def halfplane_agreement(field: DataFrame, by: str = "cell_id") -> DataFrame:
    """Share of a cell's cases that do not point away from the summed vector; 0 if the sum vanishes.

    Two partial sums for each cell, joined back: no cell is collected in one task.
    """
    sums = field.groupBy(F.col(by).alias("_by")).agg(F.sum("u").alias("su"), F.sum("v").alias("sv"))
    rows = field.select(by, "u", "v").join(sums, F.col(by).eqNullSafe(F.col("_by")))
    agrees = (F.col("u") * F.col("su") + F.col("v") * F.col("sv") >= 0).cast("double")
    norm = F.sqrt(F.max("su") * F.max("su") + F.max("sv") * F.max("sv"))
    return rows.groupBy(by).agg(F.when(norm > 1e-12, F.avg(agrees)).otherwise(0.0).alias("halfplane_agreement"))


def completeness(cases: DataFrame, least: float = 0.8) -> DataFrame:
    """One row: completed, failed, their fraction and whether it reaches ``least``."""
    c = cases.agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count(F.lit(1)).alias("n"))
    fraction = F.when(F.col("n") > 0, F.col("completed") / F.col("n")).otherwise(0.0)
    return c.select("completed", "failed", fraction.alias("fraction"), (fraction >= least).alias("sufficient"))


def field_bounds(stats: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the smallest and largest value of each column."""
    return stats.agg(*[f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))])


def diagnostic_bounds(cases: DataFrame) -> DataFrame:
    """One row ``completed, median_mass, max_mass, max_cfl`` of the completed ``cases(status, mass_error, cfl)``; mass errors by size, nulls and NaN left out."""
    done = cases.where("status = 'completed'").withColumn("_mass", F.abs("mass_error"))
    (median,) = exact_percentiles(done, "_mass", (0.5,))
    real = lambda c: F.max(F.when(~F.isnan(c), F.col(c)))
    return done.agg(F.count(F.lit(1)).alias("completed"), F.lit(median).cast("double").alias("median_mass"), real("_mass").alias("max_mass"), real("cfl").alias("max_cfl"))


def exact_percentiles(rows: DataFrame, column: str, probabilities: tuple[float, ...], small: int = 100_000, cuts: int = 200) -> list[float | None]:
    """Exact percentiles (linear between neighbours) of a whole column; null values and NaN take no part, no values give None.

    Equal values are counted first. Cuts from a sketch split the distinct values
    into parts, whose counts tell the part that holds a percentile; that part is
    split again until at most ``small`` distinct values are left to be ordered.
    Only cuts and counts (``cuts`` of each) reach the driver.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    return [None if total["n"] == 0 else _at_position(values, p * (total["n"] - 1), total["low"], total["high"], small, cuts) for p in probabilities]


def _at_position(values: DataFrame, at: float, low: float, high: float, small: int, cuts: int) -> float:
    """The value at position ``at`` (from 0) of the counted ``values(v, n)``; it lies in low..high, all of them."""
    first, last, below = math.floor(at), math.ceil(at), 0
    while (inside := values.where(F.col("v").between(low, high))).count() > small:
        ends = inside.agg(F.percentile_approx("v", [k / cuts for k in range(1, cuts)]).alias("p")).first()["p"]
        part = F.size(F.filter(F.array(*[F.lit(x) for x in ends]), lambda x: x < F.col("v")))
        parts = inside.groupBy(part.alias("part")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("part").collect()
        upto, before = below, below
        for p in parts:
            if upto <= first < upto + p["n"]:
                low, before = p["low"], upto
            if upto <= last < upto + p["n"]:
                high = p["high"]
            upto += p["n"]
        below = before
    upto = inside.withColumn("upto", F.sum("n").over(W.orderBy("v")) + below)  # at most ``small`` rows
    a, b = upto.agg(F.min(F.when(F.col("upto") > first, F.col("v"))), F.min(F.when(F.col("upto") > last, F.col("v")))).first()
    return a + (b - a) * (at - first)


def color_range(stats: DataFrame, column: str, eligible: Column | None = None) -> DataFrame:
    """One row ``low, high``: 2nd and 98th percentile of eligible values, or their extremes where those coincide."""
    rows = stats if eligible is None else stats.where(eligible)
    a, b = exact_percentiles(rows, column, (0.02, 0.98))
    if a is None or b > a:
        return stats.sparkSession.createDataFrame([(a, b)], "low double, high double")
    return rows.agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"))


def reconcile_cases(expected: DataFrame, results: DataFrame) -> DataFrame:
    """``case_id, n, verdict``: ok, missing, unknown, duplicate or failed. Null ids are unknown.

    If ``results`` has ``failure_reason``, also ``reason``: that of the failed row (the smallest text of several), ``unspecified`` if it has none.
    """
    said = [F.min(F.when(F.col("status") == "failed", F.coalesce("failure_reason", F.lit("unspecified")))).alias("reason")] if "failure_reason" in results.columns else []
    e = expected.select("case_id").distinct().withColumn("wanted", F.lit(True))
    r = results.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("bad"), *said)
    j = e.join(r, "case_id", "full_outer")
    verdict = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unknown").when(F.col("n") > 1, "duplicate").when(F.col("bad") == 1, "failed").otherwise("ok")
    return j.select("case_id", F.coalesce("n", F.lit(0)).alias("n"), verdict.alias("verdict"), *["reason" for _ in said])


def stratified_design(spark, prior: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``case_ix, name, value``: for each ``prior(name, low, high)`` one sample in each of ``n`` strata, shuffled by a hash."""
    rows = spark.range(n).withColumnRenamed("id", "stratum").crossJoin(F.broadcast(prior.select("name", "low", "high")))
    order = F.row_number().over(W.partitionBy("name").orderBy(F.xxhash64(F.lit(seed), "name", "stratum"), "stratum")) - 1
    jitter = F.pmod(F.xxhash64(F.lit(seed + 1), "name", "stratum"), F.lit(1 << 30)) / float(1 << 30)
    return rows.select(order.alias("case_ix"), "name", F.round(F.col("low") + (F.col("high") - F.col("low")) * (F.col("stratum") + jitter) / n, 8).alias("value"))


def design_categories(spark, categories: dict[str, list[str]], n: int, seed: int = 0) -> DataFrame:
    """``case_ix, name, value``: each category rotates through its values, from the one that the seed names; an empty list gives none."""
    rows = [(k, len(v), list(v)) for k, v in categories.items() if v]
    c = spark.createDataFrame(rows, "name string, k int, labels array<string>")
    cases = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long")), lambda i: i < n)
    return c.withColumn("case_ix", F.explode(cases)).select("case_ix", "name", F.get("labels", ((F.col("case_ix") + F.pmod(F.lit(seed), F.col("k"))) % F.col("k")).cast("int")).alias("value"))


def case_name(case_ix: Column, prefix: str = "case-", digits: int = 4) -> Column:
    """Names from 1 on, as ``case-0001``; larger numbers take the digits they need."""
    number = (case_ix + 1).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(number) < digits, F.lpad(number, digits, "0")).otherwise(number))


def finite(*names: str):
    """A rule of :func:`run_ensemble`: these columns hold finite numbers."""
    return lambda rows: all(np.isfinite(pd.to_numeric(rows[n], errors="coerce")).all() for n in names)


#: What the rows of a case must hold to count, for results with depth, u, v, mass_error, cfl and converged.
FIELD_RULES = {
    "field is not finite": finite("depth", "u", "v"),
    "negative depth": lambda rows: (rows["depth"] >= -1e-12).all(),
    "diagnostics are not finite": finite("mass_error", "cfl"),
    "case did not converge": lambda rows: rows["converged"].eq(True).all(),
}


def run_ensemble(cases: DataFrame, solver, schema: str, key: str = "case_id", rules: dict | None = None, fail_fast: bool = False) -> DataFrame:
    """Runs a user function on each case (pandas rows in, pandas rows out); an error becomes a failed row.

    ``schema`` names the function's columns; ``status`` and ``failure_reason`` are added.
    A result counts only if it is a table with rows and all columns of ``schema``, each
    row of this case, and passes every rule (message: function of the case's rows); else
    the case fails with the first message. With ``fail_fast`` cases that have not begun
    when a case has failed are not run and have no row: the failed one leaves a mark in
    the shared folder, and all rows are written once, so that they do not change when they are read again.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    mark = f"{shared_dir(cases.sparkSession)}/stop-{uuid.uuid4().hex}" if fail_fast else None

    def checked(rows: pd.DataFrame, case) -> pd.DataFrame:
        if not isinstance(rows, pd.DataFrame):
            raise TypeError("the result is no table")
        if missing := [n for n in names if n not in rows]:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        if rows.empty:
            raise ValueError("no rows")
        if not (rows[key].eq(case) | (rows[key].isna() & pd.isna(case))).all():
            raise ValueError("rows of another case")
        for message, holds in (rules or {}).items():
            if not holds(rows):
                raise ValueError(message)
        return rows[names]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if mark and _marked(mark):
            return pd.DataFrame(columns=[*names, "status", "failure_reason"])
        try:
            return checked(solver(rows), rows[key].iloc[0]).assign(status="completed", failure_reason=None)
        except Exception as e:  # a user's function may fail in any way; the case reports it
            if mark:
                _marked(mark, leave=True)
            out = pd.DataFrame([dict.fromkeys(names)])
            out[key] = rows[key].iloc[0]
            return out.assign(status="failed", failure_reason=f"{type(e).__name__}: {e}")

    results = cases.groupBy(key).applyInPandas(run, f"{schema}, status string, failure_reason string")
    return written(results, "cases") if fail_fast else results


def _marked(path: str, leave: bool = False) -> bool:
    """Whether the mark is there; ``leave`` puts it there."""
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path)
    if leave:
        files.create_dir(at.rsplit("/", 1)[0], recursive=True)
        files.open_output_stream(at).close()
    return files.get_file_info(at).type != fs.FileType.NotFound
