"""Error metrics, rule checks and evaluations, all as tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtide.functions.scalar import criterion, exact_sum, within_ulps
from meshtide.session import settled


def error_norms(samples: DataFrame, group: str = "group") -> DataFrame:
    """Weighted L1, L2 and Linf of ``samples(group, numerical, reference, weight)``; null where the weights do not sum to more than zero."""
    e, w = F.abs(F.col("numerical") - F.col("reference")), F.col("weight")
    r = samples.groupBy(group).agg(F.sum(w * e).alias("a"), F.sum(w * e * e).alias("b"), F.max(e).alias("linf"), F.sum(w).alias("weight"), F.count(F.lit(1)).alias("n"))
    ok = F.col("weight") > 0
    return r.select(group, F.when(ok, F.col("a") / F.col("weight")).alias("l1"), F.when(ok, F.sqrt(F.col("b") / F.col("weight"))).alias("l2"), "linf", "weight", "n")


def conservation_error(initial: Column, final: Column, expected: Column, scale: Column | None = None) -> Column:
    s = F.greatest(F.lit(1.0), F.abs(initial), F.abs(final), F.abs(expected)) if scale is None else scale
    return (final - initial - expected) / s


def wetting_front(profile: DataFrame, threshold: float = 1e-8, group: str = "group") -> DataFrame:
    """Outermost wet coordinates of ``profile(group, x, depth)``; null if all are dry."""
    wet = F.when(F.col("depth") > threshold, F.col("x"))
    return profile.groupBy(group).agg(F.max(wet).alias("front_max"), F.min(wet).alias("front_min"))


def front_errors(fronts: DataFrame, references: DataFrame, length: float, front: str = "front_max", group: str = "group") -> DataFrame:
    """``group, front, reference, absolute_error, normalized_error`` of ``fronts`` against ``references(group, reference)``; null for dry groups and those without a reference."""
    if not length > 0:
        raise ValueError("the characteristic length must be positive")
    j = fronts.select(group, F.col(front).cast("double").alias("front")).join(references.select(group, F.col("reference").cast("double").alias("reference")), group, "left")
    error = F.abs(F.col("front") - F.col("reference"))
    return j.select(group, "front", "reference", error.alias("absolute_error"), (error / length).alias("normalized_error"))


def mode_projection(profile: DataFrame, mode: int, length: float, group: str = "group") -> DataFrame:
    """Least-squares amplitude on cos(mode*pi*x/length) and weighted mean of ``profile(group, x, value, weight)``."""
    c, w = F.cos(mode * math.pi * F.col("x") / length), F.col("weight")
    r = profile.groupBy(group).agg(F.sum(w).alias("w"), F.sum(w * c).alias("c"), F.sum(w * c * c).alias("cc"), F.sum(w * F.col("value")).alias("v"), F.sum(w * F.col("value") * c).alias("vc"))
    d = F.col("w") * F.col("cc") - F.col("c") * F.col("c")
    return r.select(group, F.when(d != 0, (F.col("w") * F.col("vc") - F.col("c") * F.col("v")) / d).alias("amplitude"), F.when(F.col("w") > 0, F.col("v") / F.col("w")).alias("mean"))


def assessed(checks: DataFrame, group: str) -> DataFrame:
    """``group, passed, total, status``; null verdicts count as failed."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    r = checks.groupBy(group).agg(F.count_if(ok).alias("passed"), F.count(F.lit(1)).alias("total"))
    return r.withColumn("status", F.when(F.col("passed") == F.col("total"), "passed").otherwise("failed"))


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unspecified")).alias(key)).agg(F.count(F.lit(1)).alias("n"))


def blockers(df: DataFrame, key: str, rules: list[tuple]) -> DataFrame:
    """``key, code, path``: one row for each rule (code, path, passes) that a row does not pass; null counts as not passing.

    Rules of four, (code, path, message, passes), also give ``message``, a text or a Column over the row.
    """
    said = lambda m: m if isinstance(m, Column) else F.lit(m)
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"), *[said(m).alias("message") for m in message])) for code, path, *message, ok in rules])
    return df.select(key, F.explode(F.filter(failed, lambda x: x.isNotNull())).alias("b")).select(key, "b.*")


def run_evaluation(cases: DataFrame, limits: dict[str, float], run: str = "run_id") -> DataFrame:
    """``run_id, check, value, limit, ok`` recomputed from ``cases(run_id, status, wall_s, mass_error, cfl, min_depth)``."""
    a = cases.groupBy(run).agg(
        F.count_if(F.col("status") != "completed").cast("double").alias("failed"), F.sum("wall_s").alias("wall"), F.max("cfl").alias("cfl"), F.max(F.abs("mass_error")).alias("mass"), (-F.min("min_depth")).alias("negative_depth"))
    names = [k for k in ("failed", "wall", "cfl", "mass", "negative_depth") if k in limits]
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("value"), F.lit(float(limits[k])).alias("limit")) for k in names])
    return a.select(run, F.explode(rows).alias("c")).select(run, "c.*").withColumn("ok", F.coalesce(F.col("value") <= F.col("limit"), F.lit(False)))


def report_evaluation(cases: DataFrame, reports: DataFrame, limits: dict[str, float]) -> DataFrame:
    """``run_id, kind, check, value, target, ok``: what a run's report states, against its cases and against the limits.

    ``cases(run_id, status, wall_s, sim_s, mass_error, cfl)``; ``reports(run_id, cases,
    completed, failed, nan_count, negative_count, wall_total, wall_s, memory, max_cfl,
    max_mass, sim_min, sim_max, min_depth, unchanged)``, a row for each run. Kind
    ``reported``: the value recomputed from the rows (sums do not depend on their
    order, extremes are those of completed cases) equals the stated one to 8 units
    in the last place; counts exactly. Kind ``accepted``: stated values within ``limits``
    (cases, completed_fraction, nan_count, negative_count, cfl, mass, wall, memory).
    A run without a report, or a report without cases, fails all its checks; null counts as not fulfilled.
    """
    done = F.col("status") == "completed"
    of_done = lambda f, c: f(F.when(done, c))
    own = cases.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("double").alias("own_cases"), F.count_if(done).cast("double").alias("own_completed"), F.count_if(F.col("status") == "failed").cast("double").alias("own_failed"), exact_sum(F.col("wall_s")).alias("own_wall_total"),
        of_done(F.max, F.col("cfl")).alias("own_max_cfl"), of_done(F.max, F.abs("mass_error")).alias("own_max_mass"), of_done(F.min, F.col("sim_s")).alias("own_sim_min"), of_done(F.max, F.col("sim_s")).alias("own_sim_max"))
    j = own.join(reports, "run_id", "full_outer")
    row = lambda kind, name, value, target, ok: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("check"), value.cast("double").alias("value"), target.cast("double").alias("target"), F.coalesce(ok, F.lit(False)).alias("ok"))
    stated = [row("reported", c, F.col(f"own_{c}"), F.col(c), F.col(f"own_{c}") == F.col(c)) for c in ("cases", "completed", "failed")]
    stated += [row("reported", c, F.col(f"own_{c}"), F.col(c), within_ulps(F.col(f"own_{c}"), F.col(c))) for c in ("wall_total", "max_cfl", "max_mass", "sim_min", "sim_max")]
    slack = 8 * 2.0**-52 * F.greatest(F.lit(1.0), F.col("wall_s"), F.col("wall_total"))
    stated.append(row("reported", "wall_covers_cases", F.col("wall_s"), F.col("wall_total"), F.col("wall_s") + slack >= F.col("wall_total")))
    limit = {k: F.lit(float(v)) for k, v in limits.items()}
    most = {"nan_count": "nan_count", "negative_count": "negative_count", "cfl": "max_cfl", "mass": "max_mass", "wall": "wall_s", "memory": "memory"}
    accepted = [row("accepted", "attempted", F.col("cases"), limit["cases"], F.col("cases") == limit["cases"]), row("accepted", "completed_fraction", F.col("completed") / limit["cases"], limit["completed_fraction"], F.col("completed") / limit["cases"] >= limit["completed_fraction"])]
    accepted.append(row("accepted", "failed", F.col("failed"), F.lit(0), F.col("failed") == 0))
    accepted += [row("accepted", k, F.col(c), limit[k], F.col(c) <= limit[k]) for k, c in most.items()]
    accepted += [row("accepted", "min_depth", F.col("min_depth"), F.lit(0), F.col("min_depth") >= 0), row("accepted", "unchanged", F.col("unchanged").cast("int"), F.lit(1), F.col("unchanged"))]
    both = F.col("own_cases").isNotNull() & F.col("cases").isNotNull()
    return j.select("run_id", both.alias("both"), F.explode(F.array(*stated, *accepted)).alias("c")).select("run_id", "c.kind", "c.check", "c.value", "c.target", (F.col("both") & F.col("c.ok")).alias("ok"))


def tier_evaluation(results: DataFrame, tiers: DataFrame) -> DataFrame:
    """``tier, passed, next_tier``: results(tier, wall_s) against tiers(tier, ix, limit_s); the next tier opens if passed."""
    t = tiers.withColumn("next", F.lead("tier").over(W.orderBy("ix")))  # a handful of tiers
    ok = F.coalesce(F.col("wall_s") <= F.col("limit_s"), F.lit(False))
    return t.join(results, "tier", "left").select("tier", ok.alias("passed"), F.when(ok, F.col("next")).alias("next_tier"))


def tier_report(reports: DataFrame, tiers: DataFrame, limits: dict[str, float]) -> DataFrame:
    """``tier, problems, failed, completion, passed, next_tier``: each tier's report against all limits.

    ``reports(tier, requested, completed, failed, listed, nan_count, negative_count, cfl,
    mass, wall_s, memory, min_depth)``, ``tiers(tier, ix, cases, wall_s, memory)``;
    ``limits`` holds completion, nan_count, negative_count, cfl and mass for all tiers.
    ``problems`` names what makes a report unusable (missing, accounting of
    cases, values that are not finite), ``failed`` the limits it does not meet, both in
    the order of their definition. A tier passes without either, and then the next
    tier in the order opens. A null value meets no limit.
    """
    t = tiers.select("tier", F.col("cases").alias("_cases"), F.col("wall_s").alias("_wall"), F.col("memory").alias("_memory"), F.lead("tier").over(W.orderBy("ix")).alias("_next"))  # a handful of tiers
    r = reports.withColumnRenamed("failed", "failed_cases").withColumn("_there", F.lit(True))
    c, finite = F.col, lambda k: c(k).isNotNull() & ~F.isnan(c(k).cast("double")) & (F.abs(c(k)) < float("inf"))
    needs = {"missing": c("_there"), "requested": c("requested") == c("_cases"), "accounting": (c("completed") >= 0) & (c("failed_cases") >= 0) & (c("completed") + c("failed_cases") == c("requested")), "failures": c("listed") == c("failed_cases")}
    needs |= {k: finite(k) for k in ("wall_s", "memory", "cfl", "mass", "min_depth")} | {k: c(k) >= 0 for k in ("nan_count", "negative_count")}
    completion = F.try_divide(c("completed").cast("double"), c("requested"))
    meets = {"completion": completion >= limits["completion"], **{k: c(k) <= limits[k] for k in ("nan_count", "negative_count", "cfl")}, "mass": F.abs("mass") <= limits["mass"]}
    meets |= {"wall": c("wall_s") <= c("_wall"), "memory": c("memory") <= c("_memory"), "min_depth": c("min_depth") >= 0}
    without = lambda rules: F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    j = t.join(r, "tier", "left").select("tier", without(needs).alias("problems"), without(meets).alias("failed"), completion.alias("completion"), "_next")
    passed = (F.size("problems") == 0) & (F.size("failed") == 0)
    return j.select("tier", "problems", "failed", "completion", passed.alias("passed"), F.when(passed, c("_next")).alias("next_tier"))


def ranked_by(rows: DataFrame, score: str) -> DataFrame:
    """``rows`` with ``rank``: one more than the rows with a larger ``score``; equal scores share it, nulls come last.

    Equal scores are counted first. Ranges of scores are summed apart, and only one
    count for each range is ordered as a whole.
    """
    counts = settled(rows.groupBy(F.col(score).alias("_score")).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(F.desc("_score")).withColumn("_part", F.spark_partition_id()))
    parts = counts.groupBy("_part").agg(F.sum("_n").alias("_all"))
    before = parts.select("_part", (F.sum("_all").over(W.orderBy("_part")) - F.col("_all")).alias("_before"))  # a row for each shuffle partition
    within = F.sum("_n").over(W.partitionBy("_part").orderBy(F.desc("_score"))) - F.col("_n")
    ranks = counts.withColumn("_within", within).join(F.broadcast(before), "_part").select("_score", (F.col("_before") + F.col("_within") + 1).alias("rank"))
    return rows.join(ranks, F.col(score).eqNullSafe(F.col("_score")), "left").drop("_score")


def suitability(candidates: DataFrame, weights: DataFrame) -> DataFrame:
    """Ranks ``candidates(candidate, objective, capability)`` (full 1, partial 0.35, none 0) by ``weights(objective, weight)``.

    ``score, unmet, partial`` (numbers of objectives), ``unmet_objectives`` and ``partial_objectives``
    (sorted, of those with weight) and ``rank``. Scores that agree to nine digits share a
    rank. Capabilities for objectives without a weight do not count; a candidate without any is at 0.
    """
    value = F.when(F.col("capability") == "full", 1.0).when(F.col("capability") == "partial", 0.35).otherwise(0.0)
    wanted = weights.agg(F.sum("weight").alias("whole"), F.collect_set("objective").alias("every"), F.collect_set(F.when(F.col("weight") > 0, F.col("objective"))).alias("weighty"))
    met = candidates.join(F.broadcast(weights), "objective", "left").withColumn("v", F.when(F.col("weight").isNotNull(), value).otherwise(0.0))
    by = met.groupBy("candidate").agg(F.coalesce(F.sum(F.col("v") * F.col("weight")), F.lit(0.0)).alias("points"), F.collect_set(F.when(F.col("v") > 0, F.col("objective"))).alias("some"), F.collect_set(F.when(F.col("v") == 0.35, F.col("objective"))).alias("half"))
    r = by.join(F.broadcast(wanted)).select(
        "candidate", (F.col("points") / F.col("whole")).alias("score"), F.size(F.array_except("every", "some")).cast("long").alias("unmet"), F.size("half").cast("long").alias("partial"),
        F.sort_array(F.array_except("weighty", "some")).alias("unmet_objectives"), F.sort_array(F.array_intersect("half", "weighty")).alias("partial_objectives"))
    return ranked_by(r.withColumn("_key", F.round("score", 9)), "_key").drop("_key")


def evaluate_registry(registry: DataFrame, results: DataFrame, track: str) -> DataFrame:
    """``id, status`` (missing, invalid, failed, passed) of each benchmark required for ``track``.

    ``registry(id, purpose, required_for, criteria array<struct<metric, operator, target, high>>)``,
    ``results(id, purpose, metrics map<string, double>)``.
    """
    need = registry.where(F.array_contains("required_for", track)).select("id", F.col("purpose").alias("wanted"), F.explode_outer("criteria").alias("c"))
    j = need.join(results, "id", "left")
    ok = F.when(F.col("c").isNull(), True).otherwise(criterion(F.col("metrics")[F.col("c.metric")], F.col("c.operator"), F.col("c.target"), F.col("c.high")))
    g = j.groupBy("id").agg(F.first("metrics").isNull().alias("none"), F.bool_and(F.col("purpose").eqNullSafe(F.col("wanted"))).alias("valid"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"))
    return g.select("id", F.when(F.col("none"), "missing").when(~F.col("valid"), "invalid").when(~F.col("ok"), "failed").otherwise("passed").alias("status"))


def check_references(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """``source_id, problem``: unknown (used, not listed), unused and duplicate ids."""
    used, listed = candidates.select("source_id").distinct(), sources.select("source_id")
    dup = listed.groupBy("source_id").count().where("count > 1").select("source_id", F.lit("duplicate").alias("problem"))
    return used.join(listed, "source_id", "left_anti").select("source_id", F.lit("unknown").alias("problem")).union(listed.distinct().join(used, "source_id", "left_anti").select("source_id", F.lit("unused"))).union(dup)


def threshold_rules(steps: int, cfl: float = 0.95, mass: float = 1e-8) -> list[tuple[str, str, Column]]:
    """Rules for :func:`blockers` on case results (steps, nan_count, negative_depths, max_cfl, mass_error, min_depth, simulated_s, min_step_s, max_step_s)."""
    value = F.col
    finite = [(f"{k} finite", f"$.{k}", value(k).isNotNull() & ~F.isnan(k) & (F.abs(k) < float("inf"))) for k in ("max_cfl", "mass_error", "min_depth", "simulated_s", "min_step_s", "max_step_s")]
    return [
        ("steps", "$.steps", value("steps") == steps), ("nan", "$.nan_count", value("nan_count") == 0), ("negative", "$.negative_depths", value("negative_depths") == 0), *finite,
        ("cfl", "$.max_cfl", value("max_cfl").between(0.0, cfl)), ("mass", "$.mass_error", F.abs("mass_error") <= mass), ("depth", "$.min_depth", value("min_depth") >= 0),
        ("time", "$.simulated_s", value("simulated_s") > 0), ("step", "$.min_step_s", value("min_step_s") > 0), ("step range", "$.max_step_s", value("max_step_s") >= value("min_step_s")),
    ]


def station_identity(master: DataFrame, expected: DataFrame) -> DataFrame:
    """``code, name_ok, river_ok, ok`` of each ``expected(code, name, river)`` in ``master(code, name, river)``; unknown codes and nulls are not ok.

    Of several master rows with a code one has to fit.
    """
    m = master.select("code", F.col("name").alias("m_name"), F.col("river").alias("m_river"))
    name, river = F.coalesce(F.col("name") == F.col("m_name"), F.lit(False)), F.coalesce(F.col("river") == F.col("m_river"), F.lit(False))
    j = expected.select("code", "name", "river").join(m, "code", "left").groupBy("code", "name", "river")
    return j.agg(F.bool_or(name).alias("name_ok"), F.bool_or(river).alias("river_ok"), F.bool_or(name & river).alias("ok")).select("code", "name_ok", "river_ok", "ok")


def payload_identity(payloads: DataFrame, expected: DataFrame) -> DataFrame:
    """``code, name_found, river_found, address_found, ok`` of each ``expected(code, name, river, address)``: whether one of its ``payloads(code, text)`` contains them.

    ``ok`` asks for name and river in one payload. Codes without a payload, null texts and null
    expectations are not found; a payload is read where it lies, only its verdicts are grouped.
    """
    e = expected.select("code", "name", "river", "address").distinct()
    holds = lambda c: F.coalesce(F.contains("text", c), F.lit(False))
    j = e.join(payloads.select("code", "text"), "code", "left").select("code", "name", "river", "address", holds("name").alias("n"), holds("river").alias("r"), holds("address").alias("a"))
    g = j.groupBy("code", "name", "river", "address").agg(F.bool_or("n").alias("name_found"), F.bool_or("r").alias("river_found"), F.bool_or("a").alias("address_found"), F.bool_or(F.col("n") & F.col("r")).alias("ok"))
    return g.select("code", "name_found", "river_found", "address_found", "ok")


def key_differences(found: Column, wanted: Column) -> tuple[Column, Column]:
    """Missing and unexpected keys of a key array against the wanted ones; both are empty if the sets are equal."""
    return F.array_except(wanted, found), F.array_except(found, wanted)
