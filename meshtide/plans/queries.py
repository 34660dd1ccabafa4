"""Registered queries of the library's own operators, each with the same result in SQL where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtide.functions import geo, scalar
from meshtide.operators import ensemble, graph, mesh, quality, raster, series, spatial, web
from meshtide.plans import views as V
from meshtide.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def R(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name or x}"


_Q = ", ".join(f"round(quantile_cont({e}, {p}), 6) + 0.0 AS {n}_{q}" for n, e in (("speed", "s"), ("depth", "depth")) for p, q in zip(ensemble.PROBABILITIES, ensemble.NAMES, strict=True))
_SPREAD = ", ".join(f"round(quantile_cont({e}, {b}) - quantile_cont({e}, {a}), 6) + 0.0 AS {n}_{w}" for n, e in (("speed", "s"), ("depth", "depth")) for w, a, b in (("iqr", 0.25, 0.75), ("p95_width", 0.025, 0.975)))
_STATS = f"""x AS (SELECT *, sqrt(u * u + v * v) AS s, sqrt(u * u + v * v) > 1e-6 AND depth > 1e-6 AS act FROM field),
stats AS (SELECT cell_id, {_Q}, {_SPREAD}, {R("avg((depth > 1e-6)::INT)", "wet_probability")},
 round(least(1, coalesce(sqrt(avg(CASE WHEN act THEN u / s END) ** 2 + avg(CASE WHEN act THEN v / s END) ** 2), 0)), 6) + 0.0 AS agreement,
 round(atan2(avg(CASE WHEN act THEN v / s END), avg(CASE WHEN act THEN u / s END)), 6) + 0.0 AS direction,
 count(*) FILTER (act) AS active, {R("count(*) FILTER (act) / count(*)", "support")}, count(*) FILTER (act) >= 2 AS eligible FROM x GROUP BY cell_id)"""


@query(f"WITH {V.FIELD}, {_STATS} SELECT * FROM stats")
def ensemble_cell_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.cell_statistics(V.field(spark, sf)))


@query(f"""WITH {V.FIELD}, s AS (SELECT *, sum(u) OVER (PARTITION BY cell_id) AS su, sum(v) OVER (PARTITION BY cell_id) AS sv FROM field)
SELECT cell_id, round(CASE WHEN sqrt(any_value(su) ** 2 + any_value(sv) ** 2) > 1e-12 THEN avg((u * su + v * sv >= 0)::INT) ELSE 0 END, 6) + 0.0 AS halfplane_agreement FROM s GROUP BY cell_id""")
def ensemble_halfplane_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.halfplane_agreement(V.field(spark, sf)))


@query(f"""WITH {V.CASES} SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
round(count(*) FILTER (status = 'completed') / count(*), 6) + 0.0 AS fraction, count(*) FILTER (status = 'completed') / count(*) >= 0.8 AS sufficient FROM cases""")
def ensemble_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.completeness(V.cases(spark, sf)))


@query(f"WITH {V.FIELD}, {_STATS} SELECT " + ", ".join(f"{f}({c}) AS {f}_{c}" for c in ("speed_median", "depth_iqr", "agreement") for f in ("min", "max")) + " FROM stats")
def ensemble_field_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.field_bounds(ensemble.cell_statistics(V.field(spark, sf)), ["speed_median", "depth_iqr", "agreement"]))


@query(f"""WITH {V.FIELD}, p AS (SELECT quantile_cont(depth, 0.02) AS a, quantile_cont(depth, 0.98) AS b, min(depth) AS c, max(depth) AS d FROM field)
SELECT round(CASE WHEN b > a THEN a ELSE c END, 6) + 0.0 AS low, round(CASE WHEN b > a THEN b ELSE d END, 6) + 0.0 AS high FROM p""")
def ensemble_color_range(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.color_range(V.field(spark, sf), "depth"))


@query(f"""WITH {V.CASES}, r AS (SELECT case_id // 2 * 2 AS case_id, count(*) AS n, max((status = 'failed')::INT) AS bad FROM cases GROUP BY 1), e AS (SELECT DISTINCT c_custkey AS case_id FROM customer)
SELECT coalesce(e.case_id, r.case_id) AS case_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN e.case_id IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' WHEN bad = 1 THEN 'failed' ELSE 'ok' END AS verdict FROM e FULL JOIN r ON e.case_id = r.case_id""")
def ensemble_reconcile_cases(spark: SparkSession, sf: str) -> DataFrame:
    expected = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))
    results = V.cases(spark, sf).withColumn("case_id", F.expr("case_id div 2 * 2"))
    return ensemble.reconcile_cases(expected, results)


@query(f"""WITH {V.SERIES}, s AS (SELECT series_id, t, max(value) AS value FROM series WHERE flag <> 'click' GROUP BY 1, 2),
q AS (SELECT series_id, t + 600 AS t, ordinal FROM series WHERE flag = 'click'),
a AS (SELECT q.*, s.t AS ta, s.value AS av FROM q ASOF LEFT JOIN s ON q.series_id = s.series_id AND q.t >= s.t),
b AS (SELECT a.*, s.t AS tb, s.value AS bv FROM a ASOF LEFT JOIN s ON a.series_id = s.series_id AND a.t <= s.t)
SELECT series_id, t, round(CASE WHEN ta IS NULL THEN bv WHEN tb IS NULL THEN av WHEN ta = tb THEN av ELSE av + (bv - av) * (t - ta) / (tb - ta) END, 6) + 0.0 AS value FROM b""")
def series_interpolate_at(spark: SparkSession, sf: str) -> DataFrame:
    s = V.series(spark, sf)
    q = s.where("flag = 'click'").select("series_id", (F.col("t") + 600).alias("t"))
    return rounded(series.interpolate_at(s.where("flag <> 'click'").select("series_id", "t", "value"), q))


@query(f"""WITH {V.SERIES}, d AS (SELECT *, CASE WHEN value >= 60 THEN 1 WHEN value <= 20 THEN 0 END AS x FROM series),
w AS (SELECT *, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING), 0) AS wet FROM d)
SELECT series_id, ordinal, wet, coalesce(lag(wet) OVER o = 0 AND wet = 1, false) AS newly_wet, coalesce(lag(wet) OVER o = 1 AND wet = 0, false) AS newly_dry FROM w WINDOW o AS (PARTITION BY series_id ORDER BY ordinal)""")
def series_wet_dry_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    return series.hysteresis(V.series(spark, sf), 60, 20, "series_id", "ordinal", "value").select("series_id", "ordinal", "wet", "newly_wet", "newly_dry")


@query(f"""WITH {V.SERIES}, l AS (SELECT *, coalesce(t <= lag(t) OVER (PARTITION BY series_id ORDER BY ordinal), false) AS bad FROM series)
SELECT series_id, count(*) AS n, count(*) FILTER (bad) AS violations, count(*) FILTER (bad) = 0 AND count(*) >= 2 AS ok FROM l GROUP BY 1""")
def series_order_violations(spark: SparkSession, sf: str) -> DataFrame:
    return series.order_violations(V.series(spark, sf))


@query(f"""WITH {V.SERIES} SELECT series_id, count(*) AS n, min(t) AS first, max(t) AS last, count(*) FILTER (flag = 'error') AS errors, count(DISTINCT flag) AS kinds FROM series GROUP BY 1""")
def series_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = series.series_summary(V.series(spark, sf))
    return s.select("series_id", "n", "first", "last", F.coalesce(F.col("flags")["error"], F.lit(0)).alias("errors"), F.size("flags").cast("long").alias("kinds"))


@query(f"""WITH {V.SERIES}, s AS (SELECT series_id, floor(t / 1800) * 1800 AS t, least(100, avg(value)) AS score FROM series GROUP BY 1, 2),
n AS (SELECT series_id, unnest([t - 1800, t, t + 1800]) AS t, score AS near FROM s),
w AS (SELECT s.series_id, s.t, any_value(score) AS single, least(100, greatest(0, 0.65 * avg(near) + 0.35 * max(near))) AS win FROM s JOIN n USING (series_id, t) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(win, 9) DESC, t) AS ix FROM w),
b AS (SELECT series_id, t AS best_t, win AS best_score FROM k WHERE ix = 1),
c AS (SELECT series_id, arg_min(k.t, CASE WHEN abs(k.t - best_t) > 5400 THEN ix ELSE ix + 1e9 END) AS second_t FROM k JOIN b USING (series_id) WHERE ix > 1 GROUP BY 1),
v AS (SELECT series_id, t AS avoid_t FROM w QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(single, 9), t) = 1)
SELECT series_id, best_t, round(best_score, 6) + 0.0 AS best_score, second_t, avoid_t FROM b LEFT JOIN c USING (series_id) LEFT JOIN v USING (series_id)""")
def series_prime_windows(spark: SparkSession, sf: str) -> DataFrame:
    s = V.series(spark, sf).groupBy("series_id", (F.floor(F.col("t") / 1800) * 1800).cast("double").alias("t")).agg(F.least(F.lit(100.0), F.avg("value")).alias("score"))
    return rounded(series.prime_windows(s))


@query(f"WITH {V.RUNS}, {V.PIXELS} SELECT count(*) AS pixels FROM (SELECT DISTINCT row, x FROM pixels)")
def raster_pixel_count(spark: SparkSession, sf: str) -> DataFrame:
    return raster.pixel_count(raster.merged_runs(V.runs(spark, sf)))


@query(f"""WITH {V.RUNS}, {V.PIXELS}, p AS (SELECT DISTINCT row, x FROM pixels), i AS (SELECT row, x, x - row_number() OVER (PARTITION BY row ORDER BY x) AS k FROM p)
SELECT row, min(x) AS x0, max(x) AS x1 FROM i GROUP BY row, k""")
def raster_encode_runs(spark: SparkSession, sf: str) -> DataFrame:
    return raster.encode_runs(raster.decode_runs(V.runs(spark, sf)))


@query(f"""WITH {V.RUNS}, {V.PIXELS}, a AS (SELECT DISTINCT row, x FROM pixels WHERE half = 0), b AS (SELECT DISTINCT row, x FROM pixels WHERE half = 1)
SELECT row, count(*) FILTER (k = 'a') AS added, count(*) FILTER (k = 'r') AS removed FROM (SELECT row, x, 'a' AS k FROM (FROM b EXCEPT FROM a) UNION ALL SELECT row, x, 'r' FROM (FROM a EXCEPT FROM b)) GROUP BY row""")
def raster_diff(spark: SparkSession, sf: str) -> DataFrame:
    r = V.runs(spark, sf)
    return raster.raster_diff(r.where("half = 0"), r.where("half = 1"))


@query(f"""WITH {V.RUNS}, {V.POINTS} SELECT id FROM points p WHERE EXISTS (SELECT 1 FROM runs r WHERE r.row = floor(p.y) AND floor(p.x) BETWEEN r.x0 AND r.x1)""")
def raster_point_in_runs(spark: SparkSession, sf: str) -> DataFrame:
    return raster.point_in_runs(V.points(spark, sf), raster.merged_runs(V.runs(spark, sf)), "x", "y").select("id")


@query()
def raster_components(spark: SparkSession, sf: str) -> DataFrame:
    return raster.run_components(V.runs(spark, sf))


_CELLS = "cells AS (SELECT DISTINCT floor(x / 18)::BIGINT AS ix, floor(y / 18)::BIGINT AS iy FROM points WHERE score > 0.035)"


@query(f"""WITH {V.POINTS}, {_CELLS} SELECT DISTINCT ix + a AS ix, iy + b AS iy FROM cells, (VALUES (-1), (0), (1)) t(a), (VALUES (-1), (0), (1)) s(b)""")
def raster_bin_and_dilate(spark: SparkSession, sf: str) -> DataFrame:
    return raster.dilated(V.points(spark, sf).where("score > 0.035"), 18)


@query(f"""WITH {V.POINTS}, {_CELLS}, n AS (SELECT ix + a AS ix, iy + b AS iy FROM cells, (VALUES (-1), (0), (1)) t(a), (VALUES (-1), (0), (1)) s(b) WHERE a <> 0 OR b <> 0),
f AS (SELECT ix, iy FROM n GROUP BY 1, 2 HAVING count(*) >= 5), x AS (SELECT min(ix) a, max(ix) b, min(iy) c, max(iy) d FROM cells)
SELECT ix, iy FROM cells UNION SELECT ix, iy FROM f, x WHERE ix > a AND ix < b AND iy > c AND iy < d""")
def raster_close_holes(spark: SparkSession, sf: str) -> DataFrame:
    c = V.points(spark, sf).where("score > 0.035").select(F.floor(F.col("x") / 18).alias("ix"), F.floor(F.col("y") / 18).alias("iy")).distinct()
    return raster.closed_holes(c)


@query(f"""WITH {V.POINTS}, {_CELLS} SELECT ix, iy, dx, dy FROM cells c, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy) WHERE NOT EXISTS (SELECT 1 FROM cells o WHERE o.ix = c.ix + dx AND o.iy = c.iy + dy)""")
def raster_region_outline(spark: SparkSession, sf: str) -> DataFrame:
    c = V.points(spark, sf).where("score > 0.035").select(F.floor(F.col("x") / 18).alias("ix"), F.floor(F.col("y") / 18).alias("iy")).distinct()
    return raster.region_outline(c)


@query(f"WITH {V.GRAPH} SELECT node_id, round(sum(f), 8) + 0.0 AS residual FROM (SELECT \"left\" AS node_id, f FROM flux UNION ALL SELECT \"right\", -f FROM flux UNION ALL SELECT node_id, 0 FROM nodes) GROUP BY 1")
def graph_node_balance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.node_balance(V.edges(spark, sf), V.nodes(spark, sf)), 8)


@query(f"""WITH {V.GRAPH}, b AS (SELECT node_id, CASE node_id % 2 WHEN 0 THEN 2.0 * (value - 1) ELSE 0.5 END AS f FROM nodes WHERE node_id % 5 = 0),
t AS (SELECT node_id, sum(i) AS i, sum(o) AS o FROM (SELECT "left" AS node_id, f AS i, 0 AS o FROM flux UNION ALL SELECT "right", -f, 0 FROM flux UNION ALL SELECT node_id, 0, f FROM b UNION ALL SELECT node_id, 0, 0 FROM nodes) GROUP BY 1)
SELECT node_id, round(i + o, 8) + 0.0 AS outflow, 0.0::DOUBLE AS source, round(o, 8) + 0.0 AS boundary, round(-(i + o) / (node_id % 7 + 1), 8) + 0.0 AS rate FROM t""")
def graph_node_rate(spark: SparkSession, sf: str) -> DataFrame:
    n = V.nodes(spark, sf)
    b = n.where("node_id % 5 = 0").select("node_id", F.when(F.col("node_id") % 2 == 0, "dirichlet").otherwise("flux").alias("kind"), F.lit(2.0).alias("coefficient"), F.when(F.col("node_id") % 2 == 0, 1.0).otherwise(0.5).alias("value")).distinct()
    cap = n.select("node_id", (F.col("node_id") % 7 + 1).cast("double").alias("capacity"))
    return rounded(graph.node_rate(V.edges(spark, sf), n, cap, b), 8)


@query(f"""WITH {V.GRAPH}, d AS (SELECT n, sum(w) AS w FROM (SELECT "left" AS n, w FROM edges UNION ALL SELECT "right", w FROM edges) GROUP BY 1) SELECT round(min(0.9 * (n % 7 + 1) / w), 9) + 0.0 AS dt FROM d WHERE w > 0""")
def graph_stable_step(spark: SparkSession, sf: str) -> DataFrame:
    cap = V.nodes(spark, sf).select("node_id", (F.col("node_id") % 7 + 1).cast("double").alias("capacity"))
    return rounded(graph.stable_step(V.edges(spark, sf), cap), 9)


@query(f"""WITH {V.GRAPH}, f AS (SELECT edge_id AS face_id, "left", "right", f AS flux, CASE WHEN f >= 0 THEN "left" ELSE "right" END AS donor FROM flux),
o AS (SELECT donor, sum(abs(flux)) AS o FROM f GROUP BY 1), a AS (SELECT donor, CASE WHEN o = 0 THEN 1 ELSE least(1, greatest(0, coalesce(abs(value) * 100, 0)) / (0.5 * o)) END AS alpha FROM o LEFT JOIN nodes ON node_id = donor)
SELECT face_id, "left", "right", round(flux, 8) + 0.0 AS flux, round(alpha, 8) + 0.0 AS alpha, round(flux * alpha, 8) + 0.0 AS limited FROM f LEFT JOIN a USING (donor)""")
def graph_drain_limiter(spark: SparkSession, sf: str) -> DataFrame:
    f = graph.edge_flux(V.edges(spark, sf), V.nodes(spark, sf)).select(F.col("edge_id").alias("face_id"), "left", "right", "flux")
    c = V.nodes(spark, sf).select(F.col("node_id").alias("cell_id"), (F.abs("value") * 100).alias("available"))
    return rounded(graph.drain_limiter(f, c, 0.5), 8)


@query("""SELECT l_orderkey AS id, l_linenumber AS ix, round(o_totalprice * l_quantity / nullif(sum(l_quantity) OVER (PARTITION BY l_orderkey), 0), 8) + 0.0 AS share FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""")
def graph_distribute_by_length(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ix"), F.col("l_quantity").alias("length"))
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"))
    return rounded(graph.distribute_by_length(t, f), 8)


@query("""SELECT l_returnflag AS "group", round(sum(l_quantity * abs(l_discount - l_tax)) / sum(l_quantity), 6) + 0.0 AS l1, round(sqrt(sum(l_quantity * (l_discount - l_tax) ** 2) / sum(l_quantity)), 6) + 0.0 AS l2, round(max(abs(l_discount - l_tax)), 6) + 0.0 AS linf, round(sum(l_quantity), 6) + 0.0 AS weight, count(*) AS n FROM lineitem GROUP BY 1""")
def quality_error_norms(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("group"), F.col("l_discount").alias("numerical"), F.col("l_tax").alias("reference"), F.col("l_quantity").alias("weight"))
    return rounded(quality.error_norms(s))


@query("""SELECT l_shipdate::VARCHAR AS "group", max(CASE WHEN l_discount > 0.03 THEN l_quantity END) AS front_max, min(CASE WHEN l_discount > 0.03 THEN l_quantity END) AS front_min FROM lineitem GROUP BY l_shipdate""".replace("l_shipdate::VARCHAR", "l_suppkey").replace("GROUP BY l_shipdate", "GROUP BY l_suppkey"))
def quality_wetting_front(spark: SparkSession, sf: str) -> DataFrame:
    return quality.wetting_front(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("group"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("depth")), 0.03)


_LIMITS = {"failed": 0.0, "wall": 36000.0, "cfl": 0.95, "mass": 1e-8, "negative_depth": 0.0}


@query(f"""WITH {V.CASES}, a AS (SELECT run_id, count(*) FILTER (status <> 'completed')::DOUBLE AS failed, sum(wall_s) AS wall, max(cfl) AS cfl, max(abs(mass_error)) AS mass, -min(min_depth) AS negative_depth FROM cases GROUP BY 1)
{" UNION ALL ".join(f"SELECT run_id, '{k}' AS check, round({k}, 6) + 0.0 AS value, round({v}::DOUBLE, 6) + 0.0 AS limit, {k} <= {v} AS ok FROM a" for k, v in _LIMITS.items())}""".replace(" AS check", ' AS "check"').replace(" AS limit", ' AS "limit"'))
def quality_run_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.run_evaluation(V.cases(spark, sf), _LIMITS))


@query("SELECT coalesce(o_orderpriority, 'unspecified') AS o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def quality_count_by(spark: SparkSession, sf: str) -> DataFrame:
    return quality.count_by(table(spark, sf, "orders"), "o_orderpriority")


@query(f"""WITH {V.CASES} SELECT case_id, 'status' AS code, '$.status' AS path FROM cases WHERE status <> 'completed' UNION ALL SELECT case_id, 'cfl', '$.cfl' FROM cases WHERE NOT cfl <= 0.9 UNION ALL SELECT case_id, 'depth', '$.min_depth' FROM cases WHERE NOT min_depth >= 0.05""")
def quality_blockers(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("status", "$.status", F.col("status") == "completed"), ("cfl", "$.cfl", F.col("cfl") <= 0.9), ("depth", "$.min_depth", F.col("min_depth") >= 0.05)]
    return quality.blockers(V.cases(spark, sf), "case_id", rules)


@query("""WITH u AS (SELECT DISTINCT l_suppkey AS s FROM lineitem), k AS (SELECT s_suppkey + 3 AS s FROM supplier UNION ALL SELECT s_suppkey + 3 FROM supplier WHERE s_nationkey = 3)
SELECT s AS source_id, 'unknown' AS problem FROM u WHERE s NOT IN (SELECT s FROM k) UNION ALL SELECT DISTINCT s, 'unused' FROM k WHERE s NOT IN (SELECT s FROM u) UNION ALL SELECT s, 'duplicate' FROM k GROUP BY s HAVING count(*) > 1""")
def quality_check_references(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    listed = s.select((F.col("s_suppkey") + 3).alias("source_id"))
    return quality.check_references(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source_id")), listed.union(s.where("s_nationkey = 3").select(F.col("s_suppkey") + 3)))


@query(f"""WITH {V.MESH} SELECT cell_id, a, CASE WHEN d < 0 THEN c ELSE b END AS b, CASE WHEN d < 0 THEN b ELSE c END AS c, abs(d) / 2 AS area, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, NULL::VARCHAR AS reason FROM
(SELECT tri.*, (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) AS d, (p.x + q.x + r.x) / 3 AS x, (p.y + q.y + r.y) / 3 AS y FROM tri JOIN vert p ON p.vertex_id = a JOIN vert q ON q.vertex_id = b JOIN vert r ON r.vertex_id = c)""")
def mesh_triangle_geometry(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mesh.triangle_geometry(*V.mesh(spark, sf)))


@query(f"WITH {V.MESH} SELECT lo, hi, \"left\", coalesce(\"right\", -1) AS \"right\", n, CASE n WHEN 1 THEN 'boundary' WHEN 2 THEN 'interior' ELSE 'nonmanifold' END AS kind FROM edge")
def mesh_edge_incidence(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.edge_incidence(V.mesh(spark, sf)[0]).withColumn("right", F.coalesce("right", F.lit(-1)))


@query(f"WITH {V.MESH} SELECT cell_id, count(*) AS n, min(o) AS least, max(o) AS largest FROM (SELECT \"left\" AS cell_id, \"right\" AS o FROM edge WHERE n = 2 UNION ALL SELECT \"right\", \"left\" FROM edge WHERE n = 2) GROUP BY 1")
def mesh_cell_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    n = mesh.cell_neighbours(mesh.edge_incidence(V.mesh(spark, sf)[0]))
    return n.select("cell_id", F.size("neighbours").cast("long").alias("n"), F.array_min("neighbours").alias("least"), F.array_max("neighbours").alias("largest"))


@query(f"WITH {V.MESH} SELECT cell_id, 0.0::DOUBLE AS nx, 0.0::DOUBLE AS ny FROM tri")
def mesh_closure_check(spark: SparkSession, sf: str) -> DataFrame:
    tri, v = V.mesh(spark, sf)
    r = rounded(mesh.closure_check(mesh.edge_incidence(tri), v, mesh.triangle_geometry(tri, v)))
    return r.select("cell_id", F.abs("nx").alias("nx"), F.abs("ny").alias("ny"))


@query(f"""WITH {V.MESH}, {V.POINTS}, t AS (SELECT cell_id, p.x ax, p.y ay, q.x bx, q.y by_, r.x cx, r.y cy, (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) AS d FROM tri JOIN vert p ON p.vertex_id = a JOIN vert q ON q.vertex_id = b JOIN vert r ON r.vertex_id = c),
z AS (SELECT id, x / 16 AS x, y / 40 AS y FROM points),
h AS (SELECT id, min(cell_id) AS cell_id FROM z JOIN t ON z.x BETWEEN least(ax, bx, cx) AND greatest(ax, bx, cx) AND z.y BETWEEN least(ay, by_, cy) AND greatest(ay, by_, cy)
 WHERE ((bx - x) * (cy - y) - (by_ - y) * (cx - x)) / d >= -1e-12 AND ((cx - x) * (ay - y) - (cy - y) * (ax - x)) / d >= -1e-12 AND 1 - ((bx - x) * (cy - y) - (by_ - y) * (cx - x)) / d - ((cx - x) * (ay - y) - (cy - y) * (ax - x)) / d >= -1e-12 GROUP BY id)
SELECT id AS point_id, coalesce(cell_id, -1) AS cell_id FROM z LEFT JOIN h USING (id)""")
def mesh_locate(spark: SparkSession, sf: str) -> DataFrame:
    p = V.points(spark, sf).select(F.col("id").alias("point_id"), (F.col("x") / 16).alias("x"), (F.col("y") / 40).alias("y"))
    return mesh.locate_in_mesh(p, *V.mesh(spark, sf), bucket=2.0).select("point_id", F.coalesce("cell_id", F.lit(-1)).alias("cell_id"))


_KINDS = (("interior", "r IS NOT NULL"), ("boundary", "r IS NULL"))
_AUDIT = [("bad cells", "(SELECT count(*) FROM cen WHERE area = 0)", "=", "0"), ("least area", "(SELECT min(area) FROM cen)", ">", "0"), ("total area", "(SELECT sum(area) FROM cen)", ">", "0"), ("nonmanifold edges", "(SELECT count(*) FROM edge WHERE n > 2)", "=", "0"),
    ("components", "(SELECT CASE WHEN (SELECT count(*) FROM reach) = count(*) THEN 1 ELSE -1 END FROM tri)", "=", "1"), ("vertex count", "(SELECT count(*) FROM vert)", "=", "(SELECT count(*) FROM vert WHERE vertex_id % 29 > 0)"), ("cell count", "(SELECT count(*) FROM tri)", "=", "(SELECT count(*) FROM tri)"),
    ("triangle vertex sets", "(SELECT count(*) FROM tri WHERE cell_id % 31 = 0)", "=", "0")]
for _kind, _there in _KINDS:
    _of = lambda x, t="j", there=_there: f"(SELECT {x} FROM {t} WHERE {there})"
    _AUDIT += [(f"{_kind} face count", _of("count(*)", "f"), "=", _of("count(*)", "e")), (f"{_kind} edges", _of("count(*) FILTER (again IS NULL OR again = 1)"), "=", "0"), (f"{_kind} cells", _of("count(*) FILTER (again IS NOT NULL AND lo % 7 = 0)"), "=", "0"),
        (f"{_kind} length error", _of("max(abs(elen - len) / greatest(1, elen, len))"), "<=", "1e-9"), (f"{_kind} midpoint error", _of("max(abs(emx - mx))"), "<=", "1e-9")]
    _AUDIT.append((f"{_kind} centre distance error", _of("max(abs(ecd - cd) / greatest(1, ecd, cd))"), "<=", "1e-9") if _kind == "interior" else (f"{_kind} markers", _of("count(*) FILTER (again IS NOT NULL AND lo % 13 = 0)"), "=", "0"))


@query(f"""WITH RECURSIVE {V.MESH}, adjacent AS (SELECT "left" AS p, "right" AS q FROM edge WHERE n = 2 UNION ALL SELECT "right", "left" FROM edge WHERE n = 2), reach(c) AS (SELECT min(cell_id) FROM tri UNION SELECT q FROM reach JOIN adjacent ON p = c),
cen AS (SELECT cell_id, (p.x + q.x + r.x) / 3 AS x, (p.y + q.y + r.y) / 3 AS y, abs((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) / 2 AS area FROM tri JOIN vert p ON p.vertex_id = a JOIN vert q ON q.vertex_id = b JOIN vert r ON r.vertex_id = c),
f AS (SELECT lo, hi, "right" AS r, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS len, sqrt((u.x - w.x) ** 2 + (u.y - w.y) ** 2) AS cd, (p.x + q.x) / 2 AS mx FROM edge JOIN vert p ON p.vertex_id = lo JOIN vert q ON q.vertex_id = hi JOIN cen u ON u.cell_id = "left" LEFT JOIN cen w ON w.cell_id = "right"),
g AS (SELECT lo, hi, r, len * CASE WHEN lo % 17 = 0 THEN 1.5 ELSE 1 END AS elen, cd + CASE WHEN lo % 19 = 0 THEN 0.25 ELSE 0 END AS ecd, mx + CASE WHEN lo % 23 = 0 THEN 0.5 ELSE 0 END AS emx, 0 AS again FROM f WHERE lo % 50 > 0),
e AS (FROM g UNION ALL SELECT lo, hi, r, elen, ecd, emx, 1 FROM g WHERE lo % 11 = 3), j AS (SELECT f.*, elen, ecd, emx, again FROM f LEFT JOIN e ON e.lo = f.lo AND e.hi = f.hi)
{" UNION ALL ".join(f"SELECT '{name}' AS name, round({v}::DOUBLE, 6) + 0.0 AS value, round({x}::DOUBLE, 6) + 0.0 AS expected, {v} {how} {x} AS ok" for name, v, how, x in _AUDIT)}""")
def mesh_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The mesh against an export with faces, cells, lengths, places, markers, corners and vertices spoilt by rule."""
    tri, v = V.mesh(spark, sf)
    f = mesh.face_geometry(mesh.edge_incidence(tri), v, mesh.triangle_geometry(tri, v)).withColumnsRenamed({"lo": "a", "hi": "b"}).withColumn("marker", F.col("a") % 3)
    spoilt = lambda k, value: F.when(F.col("a") % k == 0, value)
    e = f.where("a % 50 > 0").withColumns({
        "left": spoilt(7, F.col("left") + 1_000_000_000).otherwise(F.col("left")), "length": spoilt(17, F.col("length") * 1.5).otherwise(F.col("length")), "centre_distance": spoilt(19, F.col("centre_distance") + 0.25).otherwise(F.col("centre_distance")),
        "mx": spoilt(23, F.col("mx") + 0.5).otherwise(F.col("mx")), "marker": spoilt(13, F.lit(9)).otherwise(F.col("marker"))})
    exported = {"faces": e.union(e.where("a % 11 = 3")), "vertices": v.where("vertex_id % 29 > 0"), "triangles": tri.withColumn("a", F.when(F.col("cell_id") % 31 == 0, F.col("a") + 1_000_000).otherwise(F.col("a")))}
    return rounded(mesh.mesh_audit(tri, v, exported, markers=f.where("kind = 'boundary'")).withColumnRenamed("check", "name"))


_POLY = [(0, 0, 100.0, 100.0, 800.0, 140.0), (0, 0, 800.0, 140.0, 620.0, 700.0), (0, 0, 620.0, 700.0, 100.0, 100.0), (0, 1, 400.0, 200.0, 500.0, 200.0), (0, 1, 500.0, 200.0, 450.0, 300.0), (0, 1, 450.0, 300.0, 400.0, 200.0), (1, 0, 50.0, 600.0, 300.0, 600.0), (1, 0, 300.0, 600.0, 300.0, 900.0), (1, 0, 300.0, 900.0, 50.0, 600.0)]
_POLY_SQL = "poly(feature, ring, ax, ay, bx, by_) AS (VALUES " + ", ".join(map(str, _POLY)) + ")"


@query(f"""WITH {V.POINTS}, {_POLY_SQL}, n AS (SELECT id, feature, ring, count(*) % 2 AS odd FROM points, poly WHERE (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / (by_ - ay) + ax GROUP BY 1, 2, 3)
SELECT id, feature FROM n WHERE odd = 1 GROUP BY 1, 2 HAVING max((ring = 0)::INT) = 1 AND max((ring > 0)::INT) = 0""")
def spatial_point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.createDataFrame(_POLY, "feature int, ring int, ax double, ay double, bx double, by double")
    return spatial.point_in_polygon(V.points(spark, sf), e, 50.0)


_DIST = "sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2)"


@query(f"""WITH {V.POINTS}, c AS (SELECT p.id AS target, s.id AS stand, {_DIST} AS d, p.score * (0.70 + 0.30 * exp(-0.5 * (({_DIST} - 34) / 30) ** 2)) AS score FROM points p JOIN points s ON abs(p.x - s.x) <= 100 AND abs(p.y - s.y) <= 100 WHERE p.scene = 'click' AND s.scene = 'view' AND {_DIST} <= 100 AND {_DIST} >= 2)
SELECT target, stand, round(d, 6) + 0.0 AS d, round(score, 6) + 0.0 AS score FROM c QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, stand) = 1""")
def spatial_best_stand(spark: SparkSession, sf: str) -> DataFrame:
    p = V.points(spark, sf)
    return rounded(spatial.best_stand(p.where("scene = 'click'"), p.where("scene = 'view'"))).select("target", "stand", "d", "score")


@query(f"""WITH {V.POINTS} SELECT id FROM points p WHERE scene = 'error' AND NOT EXISTS (SELECT 1 FROM points s WHERE s.scene = 'signup' AND {_DIST} <= 22)""")
def spatial_drop_near(spark: SparkSession, sf: str) -> DataFrame:
    p = V.points(spark, sf)
    return spatial.drop_near(p.where("scene = 'error'"), p.where("scene = 'signup'")).select("id")


_RULES = [(100.0, 100.0, 700.0, 120.0, 24.0), (300.0, 500.0, 300.0, 500.0, 60.0), (500.0, 900.0, 900.0, 500.0, 10.0)]


@query(f"""WITH {V.POINTS}, rules(ax, ay, bx, by_, buffer) AS (VALUES {", ".join(map(str, _RULES))}), t AS (SELECT *, CASE WHEN (bx - ax) ** 2 + (by_ - ay) ** 2 = 0 THEN 0 ELSE least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) END AS t FROM points, rules)
SELECT DISTINCT id FROM t WHERE sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2) <= buffer""")
def spatial_within_buffer(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.blocked_points(V.points(spark, sf), spark.createDataFrame(_RULES, "ax double, ay double, bx double, by double, buffer double"))


_AXES = [(k, i, float(x), float(y)) for k, line in enumerate((((0, 0), (400, 300), (900, 350)), ((0, 800), (500, 700), (1000, 990)))) for i, (x, y) in enumerate(line)]


@query(f"""WITH {V.POINTS}, v(line_id, ix, x, y) AS (VALUES {", ".join(map(str, _AXES))}), e AS (SELECT line_id, ix, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM v WINDOW w AS (PARTITION BY line_id ORDER BY ix)),
l AS (SELECT *, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS len FROM e WHERE bx IS NOT NULL), m AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY line_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(len) OVER (PARTITION BY line_id) AS total FROM l),
t AS (SELECT *, least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / len ** 2)) AS t FROM points, m), d AS (SELECT *, sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2) AS d, (start + t * len) / total AS progress FROM t),
n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, line_id, ix) = 1)
SELECT id, line_id, {R("d")}, {R("sign((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) * d", "offset")}, {R("progress")} FROM n""".replace('AS offset', 'AS "offset"'))
def spatial_nearest_axis(spark: SparkSession, sf: str) -> DataFrame:
    v = spark.createDataFrame(_AXES, "line_id int, ix int, x double, y double")
    return rounded(spatial.nearest_axis(V.points(spark, sf), spatial.polyline_measure(v)).select("id", "line_id", "d", "offset", "progress"))


@query()
def spatial_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    p = V.points(spark, sf)
    c = p.select("scene", "id", F.col("x").alias("tx"), F.col("y").alias("ty"), (F.col("x") + 30).alias("sx"), F.col("y").alias("sy"), "score")
    return spatial.hotspots(c)


_LL = "33.85 + id % 500 / 10000.0 AS lat, 130.65 + id % 700 / 10000.0 AS lng"


@query(f"""WITH {V.POINTS}, p AS (SELECT id, {_LL} FROM points), h AS (SELECT id, pow(sin(radians(33.87 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(33.87)) * pow(sin(radians(130.68 - lng) / 2), 2) AS h, lat, lng FROM p)
SELECT id, round(2 * 6371008.8 * asin(sqrt(least(1, h))), 3) + 0.0 AS metres, round(lng / 180 * 20037508.342789244, 3) + 0.0 AS x, round(ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi()) * 40075016.68557849, 3) + 0.0 AS y FROM h""")
def geo_projections(spark: SparkSession, sf: str) -> DataFrame:
    p = V.points(spark, sf).select("id", (33.85 + F.col("id") % 500 / 10000.0).alias("lat"), (130.65 + F.col("id") % 700 / 10000.0).alias("lng"))
    x, y = geo.web_mercator(F.col("lat"), F.col("lng"))
    return rounded(p.select("id", geo.haversine(F.col("lat"), F.col("lng"), F.lit(33.87), F.lit(130.68)).alias("metres"), x.alias("x"), y.alias("y")), 3)


@query("""WITH f AS (SELECT url, page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS station, CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END AS status FROM pages), w AS (SELECT DISTINCT station FROM f WHERE page_id % 7 = 0)
SELECT station, count(*) AS tries, count(*) FILTER (status = 200) AS ok, station IN (SELECT station FROM w) AND count(*) FILTER (status = 200) = 0 AS missing FROM f GROUP BY station""")
def web_reachability(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("station"), F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("status"))
    return web.reachability(f, f.where("status = 404"))


@query("SELECT page_id AS id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g'), ' \t\n\r') AS title, (length(html) - length(replace(html, '<a href=', ''))) // 8 AS links FROM pages")
def web_html_resources(spark: SparkSession, sf: str) -> DataFrame:
    return web.html_resources(table(spark, sf, "pages")).select("id", "title", F.size("links").cast("long").alias("links"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM documents""")
def text_safe_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", scalar.safe_name(F.col("text")).alias("name"))


_REDACTED = "text"
for _p, _by in scalar.REDACTIONS:
    _REDACTED = "regexp_replace({}, '{}', '{}', 'g')".format(_REDACTED, _p.replace("(?U)", "").replace("'", "''"), _by.replace("$", "\\"))


@query(f"SELECT doc_id, trim({_REDACTED}) AS text FROM documents")
def text_redact(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", scalar.redact(F.col("text")).alias("text"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS value, '$.k' AS path FROM events")
def json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return web.flattened(table(spark, sf, "events"), "event_id", "props").withColumnRenamed("id", "event_id")


@query("""SELECT l_orderkey, l_linenumber, round(sign(l_extendedprice / 1e4 - l_quantity / 10) * 0.6 * (l_discount + 1) * sqrt(2 * 9.81 * abs(l_extendedprice / 1e4 - l_quantity / 10)), 6) + 0.0 AS q,
(least(floor(least(1, greatest(0, l_discount * 10)) * 8), 7) + 1)::INT AS gate, round((l_quantity * 0.03 / sqrt(0.001)) ** 0.6, 6) + 0.0 AS depth FROM lineitem""")
def structure_discharge(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    q = scalar.orifice_discharge(F.col("l_extendedprice") / 1e4, F.col("l_quantity") / 10, F.lit(0.6), F.col("l_discount") + 1)
    return rounded(li.select("l_orderkey", "l_linenumber", q.alias("q"), scalar.gate_bucket(F.col("l_discount") * 10).alias("gate"), scalar.wide_channel_depth(F.col("l_quantity"), F.lit(0.001), F.lit(0.03)).alias("depth")))
