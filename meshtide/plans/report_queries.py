"""Registered queries of reports: per step, per tier, per mask, with the rows and names behind their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtide.functions import geo
from meshtide.operators import ensemble, graph, mesh, quality, raster, series, web
from meshtide.plans import views as V
from meshtide.plans.queries import query, rounded
from meshtide.session import table


@query(f"""WITH {V.SERIES}, d AS (SELECT *, CASE WHEN value >= 20 THEN 1 WHEN value <= 10 THEN 0 END AS decided FROM series),
w AS (SELECT *, coalesce(last_value(decided IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ordinal), 0) AS wet, coalesce(last_value(decided IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was,
 row_number() OVER (PARTITION BY series_id ORDER BY ordinal) > 1 AS later, floor(t / 86400) AS day, 1 + ordinal % 3 AS area, value * sqrt(13) / greatest(value, 5) AS s FROM d)
SELECT day, count(*) FILTER (wet = 1) AS wet_cells, count(*) FILTER (later AND wet = 1 AND was = 0) AS newly_wet, count(*) FILTER (later AND wet = 0 AND was = 1) AS newly_dry, count(*) FILTER (wet = 1 AND s > 2) AS capped,
round(sum(CASE WHEN wet = 0 THEN value * area ELSE 0 END), 4) + 0.0 AS removed, round(sum(CASE WHEN wet = 0 THEN 20.0 * area ELSE 0 END), 4)::DOUBLE AS removable,
round(coalesce(max(CASE WHEN wet = 1 THEN s END), 0), 4) + 0.0 AS speed_before, round(coalesce(max(CASE WHEN wet = 1 THEN least(s, 2) END), 0), 4) + 0.0 AS speed_after FROM w GROUP BY day""")
def series_step_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    s = V.series(spark, sf).select("series_id", "ordinal", F.floor(F.col("t") / 86400).cast("double").alias("day"), F.col("value").alias("h"), (F.col("value") * 3).alias("hu"), (F.col("value") * -2).alias("hv"), (1 + F.col("ordinal") % 3).cast("double").alias("area"))
    wet = series.hysteresis(s, 20.0, 10.0, key="series_id", order="ordinal")
    return rounded(series.step_diagnostics(series.regularised(wet, 5.0, 2.0), 5.0, 20.0, order="day"), 4)


@query(f"""WITH {V.SERIES}, s AS (SELECT series_id, floor(t / 1800) * 1800 AS t, least(100, avg(value)) AS score FROM series GROUP BY 1, 2), z AS (SELECT series_id, min(t) + 86400 AS now FROM s GROUP BY 1),
n AS (SELECT series_id, unnest([t - 1800, t, t + 1800]) AS t, score AS near FROM s),
w AS (SELECT s.series_id, s.t, any_value(score) AS single, least(100, greatest(0, 0.65 * avg(near) + 0.35 * max(near))) AS win FROM s JOIN z USING (series_id) JOIN n USING (series_id, t) WHERE s.t BETWEEN now AND now + 86400 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(win, 9) DESC, t) AS ix FROM w)
SELECT series_id, t AS best_t, round(win, 6) + 0.0 AS best_score, CASE WHEN win >= 80 THEN 'A' WHEN win >= 65 THEN 'B' WHEN win >= 50 THEN 'C' ELSE 'D' END AS grade FROM k WHERE ix = 1""")
def series_graded_windows(spark: SparkSession, sf: str) -> DataFrame:
    s = V.series(spark, sf).groupBy("series_id", (F.floor(F.col("t") / 1800) * 1800).cast("double").alias("t")).agg(F.least(F.lit(100.0), F.avg("value")).alias("score"))
    now = s.groupBy("series_id").agg((F.min("t") + 86400).alias("now"))
    w = series.prime_windows(s.join(now, "series_id"), F.col("now"))
    return rounded(w.select("series_id", "best_t", "best_score", series.grade(F.col("best_score")).alias("grade")))


_FIELD_NAME = "CASE event_id % 5 WHEN 0 THEN 'dschQty' WHEN 1 THEN 'Flow rate' ELSE 'stage' END"
_PAYLOAD = f"""concat('{{"obsTime":', event_id, ',"', {_FIELD_NAME}, '":{{"v":', user_id, ',"list":[{{"q', event_id % 3, '":1}}]}}}}')"""


@query(f"""WITH n AS (SELECT DISTINCT user_id AS id, unnest(['obsTime', {_FIELD_NAME}, 'v', 'list', 'q' || event_id % 3]) AS name FROM events)
SELECT id, string_agg(name, ',' ORDER BY name) AS fields, coalesce(string_agg(name, ',' ORDER BY name) FILTER (regexp_matches(name, 'dsch|discharge|flow|流量', 'i')), '') AS discharge_fields FROM n GROUP BY id""")
def series_field_names(spark: SparkSession, sf: str) -> DataFrame:
    payloads = table(spark, sf, "events").select("user_id", F.expr(_PAYLOAD).alias("payload"))
    names = series.field_names(web.flattened(payloads, "user_id", "payload"))
    return names.select("id", F.array_join("fields", ",").alias("fields"), F.array_join("discharge_fields", ",").alias("discharge_fields"))


@query("""WITH f AS (SELECT l_suppkey AS "group", max(CASE WHEN l_discount > 0.03 THEN l_quantity END)::DOUBLE AS front, avg(l_quantity) AS reference FROM lineitem GROUP BY 1)
SELECT "group", front, CASE WHEN "group" % 5 > 0 THEN round(reference, 6) + 0.0 END AS reference, CASE WHEN "group" % 5 > 0 THEN round(abs(front - reference), 6) + 0.0 END AS absolute_error, CASE WHEN "group" % 5 > 0 THEN round(abs(front - reference) / 40, 6) + 0.0 END AS normalized_error FROM f""")
def quality_front_errors(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("group"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("depth"))
    return rounded(quality.front_errors(quality.wetting_front(li, 0.03), li.where("group % 5 > 0").groupBy("group").agg(F.avg("x").alias("reference")), 40.0))


_TIER_LIMITS = {"completion": 0.65, "nan_count": 70.0, "negative_count": 25.0, "cfl": 0.965, "mass": 5.05e-9}
_TIER_NEEDS = {"missing": "there", "requested": "requested = cases", "accounting": "completed + failed = requested", "failures": "listed = failed", **{k: f"{k} IS NOT NULL" for k in ("wall_s", "memory", "cfl", "mass", "min_depth", "nan_count", "negative_count")}}
_TIER_MEETS = {"completion": "completed / requested >= 0.65", "nan_count": "nan_count <= 70", "negative_count": "negative_count <= 25", "cfl": "cfl <= 0.965", "mass": "mass <= 5.05e-9", "wall": "wall_s <= most", "memory": "memory <= 480000", "min_depth": "min_depth >= 0"}
_NAMED = lambda rules: "concat_ws(',', " + ", ".join(f"CASE WHEN coalesce({ok}, false) THEN NULL ELSE '{name}' END" for name, ok in rules.items()) + ")"


@query(f"""WITH c AS (SELECT o_custkey AS case_id, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS p, o_totalprice AS price, c_nationkey AS tier FROM orders JOIN customer ON c_custkey = o_custkey),
g AS (SELECT tier, count(*) AS requested, count(*) - sum(p) AS completed, sum(p) AS failed, sum(p) - (tier % 7 = 3)::INT AS listed, count(*) FILTER (case_id % 9 = 0) AS nan_count, count(*) FILTER (case_id % 31 = 0) AS negative_count,
 max(case_id % 97) / 100 AS cfl, max(abs(case_id % 101 - 50) * 1e-10) AS mass, sum(price) AS wall_s, max(price) AS memory, min(price) - 1200 AS min_depth FROM c GROUP BY 1),
t AS (SELECT n_nationkey AS tier, lead(n_nationkey) OVER (ORDER BY n_nationkey) AS nxt, (SELECT avg(wall_s) FROM g) * 1.05 AS most FROM nation),
j AS (SELECT t.tier, t.nxt, t.most, h.* EXCLUDE (tier), k.requested + (t.tier % 6 = 5)::INT AS cases, h.tier IS NOT NULL AS there FROM t LEFT JOIN g k ON k.tier = t.tier LEFT JOIN (SELECT * FROM g WHERE tier % 11 <> 10) h ON h.tier = t.tier),
r AS (SELECT tier, nxt, {_NAMED(_TIER_NEEDS)} AS problems, {_NAMED(_TIER_MEETS)} AS failed, round(completed / requested, 6) + 0.0 AS completion FROM j)
SELECT tier, problems, failed, completion, problems = '' AND failed = '' AS passed, CASE WHEN problems = '' AND failed = '' THEN nxt END AS next_tier FROM r""")
def quality_tier_report(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    k, p, price = F.col("o_custkey"), F.col("o_orderstatus") == "P", F.col("o_totalprice")
    g = c.groupBy(F.col("c_nationkey").alias("tier")).agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(~p).alias("completed"), F.count_if(p).alias("failed"), F.count_if(k % 9 == 0).alias("nan_count"), F.count_if(k % 31 == 0).alias("negative_count"),
        (F.max(k % 97) / 100).alias("cfl"), F.max(F.abs(k % 101 - 50) * 1e-10).alias("mass"), F.sum(price).alias("wall_s"), F.max(price).alias("memory"), (F.min(price) - 1200).alias("min_depth"))
    g = g.withColumn("listed", F.col("failed") - (F.col("tier") % 7 == 3).cast("int"))
    most = g.agg((F.avg("wall_s") * 1.05).alias("wall_s"))
    tiers = table(spark, sf, "nation").select(F.col("n_nationkey").alias("tier"), F.col("n_nationkey").alias("ix"), F.lit(480000.0).alias("memory")).join(g.select("tier", (F.col("requested") + (F.col("tier") % 6 == 5).cast("int")).alias("cases")), "tier", "left").join(F.broadcast(most))
    r = quality.tier_report(g.where("tier % 11 <> 10"), tiers, _TIER_LIMITS)
    return rounded(r.withColumn("problems", F.array_join("problems", ",")).withColumn("failed", F.array_join("failed", ",")))


@query("""SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice > 300000 THEN {'code': 'price', 'path': '$.price', 'message': 'priority ' || o_orderpriority} END, CASE WHEN o_orderstatus = 'P' THEN {'code': 'status', 'path': '$.status', 'message': 'pending'} END], lambda x: x IS NOT NULL), recursive := true) FROM orders""")
def quality_blocker_messages(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("price", "$.price", F.concat(F.lit("priority "), F.col("o_orderpriority")), F.col("o_totalprice") <= 300000), ("status", "$.status", "pending", F.col("o_orderstatus") != "P")]
    return quality.blockers(table(spark, sf, "orders"), "o_orderkey", rules)


@query("""WITH c AS (SELECT l_suppkey AS candidate, l_returnflag AS objective, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2), w(objective, weight) AS (VALUES ('A', 3), ('N', 2), ('R', 0), ('X', 1)),
v AS (SELECT s.candidate, w.objective, weight, CASE WHEN d > 0.0512345 THEN 1.0::DOUBLE WHEN d > 0.0487654 THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS v FROM (SELECT DISTINCT candidate FROM c) s CROSS JOIN w LEFT JOIN c ON c.candidate = s.candidate AND c.objective = w.objective),
s AS (SELECT candidate, round(sum(v * weight) / sum(weight), 9) + 0.0 AS score, coalesce(string_agg(objective, ',' ORDER BY objective) FILTER (v = 0 AND weight > 0), '') AS unmet_objectives, coalesce(string_agg(objective, ',' ORDER BY objective) FILTER (v = 0.35 AND weight > 0), '') AS partial_objectives FROM v GROUP BY 1)
SELECT *, rank() OVER (ORDER BY score DESC) AS "rank" FROM s""")
def quality_suitability_lists(spark: SparkSession, sf: str) -> DataFrame:
    d = F.avg("l_discount")
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("candidate"), F.col("l_returnflag").alias("objective")).agg(F.when(d > 0.0512345, "full").when(d > 0.0487654, "partial").otherwise("none").alias("capability"))
    r = quality.suitability(c, spark.createDataFrame([("A", 3.0), ("N", 2.0), ("R", 0.0), ("X", 1.0)], "objective string, weight double"))
    return rounded(r.select("candidate", "score", F.array_join("unmet_objectives", ",").alias("unmet_objectives"), F.array_join("partial_objectives", ",").alias("partial_objectives"), "rank"), 9)


@query(f"""WITH {V.GRAPH}, m AS (SELECT edge_id, max(1 - l_discount) AS m FROM edges WHERE edge_id % 2 = 0 GROUP BY 1), q AS (SELECT "left", "right", f * coalesce(m, 1) AS f FROM flux LEFT JOIN m USING (edge_id)),
b AS (SELECT node_id, CASE node_id % 2 WHEN 0 THEN 2.0 * (value - 1) ELSE 0.5 END AS o FROM nodes WHERE node_id % 5 = 0), s AS (SELECT node_id, value / 2 AS s FROM nodes WHERE node_id % 3 = 0),
t AS (SELECT sum(i) AS i, sum(o) AS o, sum(s) AS s FROM (SELECT "left" AS node_id, f AS i, 0 AS o, 0 AS s FROM q UNION ALL SELECT "right", -f, 0, 0 FROM q UNION ALL SELECT node_id, 0, o, 0 FROM b UNION ALL SELECT node_id, 0, 0, s FROM s))
SELECT round(s, 3) + 0.0 AS source, round(o, 3) + 0.0 AS boundary, round(s - o - i, 3) + 0.0 AS mass_rate, 0.0::DOUBLE AS imbalance FROM t""")
def graph_rate_totals(spark: SparkSession, sf: str) -> DataFrame:
    n, e = V.nodes(spark, sf), V.edges(spark, sf)
    b = n.where("node_id % 5 = 0").select("node_id", F.when(F.col("node_id") % 2 == 0, "dirichlet").otherwise("flux").alias("kind"), F.lit(2.0).alias("coefficient"), F.when(F.col("node_id") % 2 == 0, 1.0).otherwise(0.5).alias("value")).distinct()
    cap = n.select("node_id", (F.col("node_id") % 7 + 1).cast("double").alias("capacity"))
    m = e.where("edge_id % 2 = 0").groupBy("edge_id").agg(F.max(1 - F.col("l_discount")).alias("multiplier"))
    rates = graph.node_rate(e, n, cap, b, m, n.where("node_id % 3 = 0").select("node_id", (F.col("value") / 2).alias("source")))
    return rounded(graph.rate_totals(rates, cap), 3)


@query("""WITH s AS (SELECT l_orderkey AS id, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, round(o_totalprice, 6) + 0.0 AS total, round(CASE WHEN q > 0 THEN o_totalprice END, 4) + 0.0 AS shared, coalesce(q > 0, false) AS ok FROM orders LEFT JOIN s ON id = o_orderkey""")
def graph_share_sums(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ix"), F.col("l_quantity").alias("length"))
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"))
    s = graph.share_sums(graph.distribute_by_length(t, f), t)
    return rounded(s.withColumn("shared", F.round("shared", 4)))


@query(f"""WITH {V.MESH}, c AS (SELECT cell_id, (p.x + q.x + r.x) / 3 AS x, (p.y + q.y + r.y) / 3 AS y FROM tri JOIN vert p ON p.vertex_id = a JOIN vert q ON q.vertex_id = b JOIN vert r ON r.vertex_id = tri.c),
g AS (SELECT lo, hi, "left", q.y - p.y AS nx, p.x - q.x AS ny, (p.x + q.x) / 2 - c.x AS mx, (p.y + q.y) / 2 - c.y AS my FROM edge JOIN vert p ON p.vertex_id = lo JOIN vert q ON q.vertex_id = hi JOIN c ON c.cell_id = "left")
SELECT lo, hi, "left", round(sign(nx * mx + ny * my) * nx / sqrt(nx * nx + ny * ny), 6) + 0.0 AS nx, round(sign(nx * mx + ny * my) * ny / sqrt(nx * nx + ny * ny), 6) + 0.0 AS ny FROM g""")
def mesh_face_normals(spark: SparkSession, sf: str) -> DataFrame:
    tri, v = V.mesh(spark, sf)
    n = mesh.face_normals(mesh.edge_incidence(tri), v, mesh.triangle_geometry(tri, v))
    return rounded(n.select("lo", "hi", "left", "nx", "ny"))


_MARKS = "marks AS (SELECT p AS a, p + 1 AS b, 'south' AS marker FROM corner WHERE k % 2 = 0 UNION ALL SELECT p + 1, p, 'again' FROM corner WHERE k % 12 = 0 UNION ALL SELECT p, p + 2, 'far' FROM corner WHERE k % 9 = 0)"


@query(f"""WITH {V.MESH}, {_MARKS}, m AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, min(marker) AS marker, count(*) AS times FROM marks GROUP BY 1, 2)
SELECT lo, hi, CASE WHEN n = 1 THEN "left" END AS cell_id, marker, CASE WHEN times IS NULL THEN NULL WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'interior' WHEN times > 1 THEN 'duplicate' END AS problem FROM edge FULL JOIN m USING (lo, hi) WHERE n = 1 OR times IS NOT NULL""")
def mesh_marked_boundary(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k.alias("k"), (F.floor(k / 50) * 51 + k % 50).alias("p"))
    m = c.where("k % 2 = 0").selectExpr("p AS a", "p + 1 AS b", "'south' AS marker").union(c.where("k % 12 = 0").selectExpr("p + 1", "p", "'again'")).union(c.where("k % 9 = 0").selectExpr("p", "p + 2", "'far'"))
    return mesh.marked_boundary(mesh.edge_incidence(V.mesh(spark, sf)[0]), m)


@query(f"""WITH {V.RUNS}, {V.PIXELS}, {V.POINTS}, q AS (SELECT *, CASE WHEN id % 50 = 0 THEN NULL WHEN id % 70 = 0 THEN 'inf'::DOUBLE ELSE x END AS px, y / 2 AS py FROM points), f AS (SELECT * FROM q WHERE px IS NOT NULL AND NOT isinf(px)), k AS (SELECT count(*) AS k FROM f WHERE (floor(py)::INT, floor(px)::INT) IN (SELECT row, x FROM pixels))
SELECT count(*) AS points, any_value(k) AS kept, (SELECT count(*) FROM f) - any_value(k) AS outside, count(*) - (SELECT count(*) FROM f) AS not_finite FROM q, k""")
def raster_mask_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = V.points(spark, sf).select("id", F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 70 == 0, float("inf")).otherwise(F.col("x")).alias("px"), (F.col("y") / 2).alias("py"))
    return raster.mask_counts(p, raster.merged_runs(V.runs(spark, sf)))


@query(f"""WITH {V.POINTS}, p AS (SELECT x, y FROM points WHERE score > 0.035), o AS (SELECT min(x) - 54 AS x0, min(y) - 54 AS y0 FROM p), c AS (SELECT DISTINCT floor((x - x0) / 18)::BIGINT AS cx, floor((y - y0) / 18)::BIGINT AS cy FROM p, o),
cells AS (SELECT DISTINCT cx + a AS ix, cy + b AS iy FROM c, (VALUES (-1), (0), (1)) t(a), (VALUES (-1), (0), (1)) s(b) WHERE cx + a < 40 AND cy + b < 30)
SELECT ix, iy, dx, dy, ix + dx < 0 OR ix + dx >= 40 OR iy + dy < 0 OR iy + dy >= 30 AS open FROM cells c, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy) WHERE NOT EXISTS (SELECT 1 FROM cells o WHERE o.ix = c.ix + dx AND o.iy = c.iy + dy)""")
def raster_open_outline(spark: SparkSession, sf: str) -> DataFrame:
    cells = raster.padded_grid(V.points(spark, sf).where("score > 0.035"), 18)
    return raster.region_outline(cells.where("ix < 40 and iy < 30"), (40, 30))


@query(f"""WITH {V.POINTS}, a AS (SELECT DISTINCT floor(x / 18)::BIGINT AS ix, floor(y / 18)::BIGINT AS iy FROM points WHERE score > 0.5 AND scene = 'click'), b AS (SELECT DISTINCT floor(x / 18)::BIGINT AS ix, floor(y / 18)::BIGINT AS iy FROM points WHERE score > 0.6 AND scene = 'view')
SELECT coalesce(a.ix, b.ix) AS ix, coalesce(a.iy, b.iy) AS iy, a.ix IS NOT NULL AS expected, b.ix IS NOT NULL AS actual FROM a FULL JOIN b ON a.ix = b.ix AND a.iy = b.iy WHERE a.ix IS NULL OR b.ix IS NULL ORDER BY iy, ix LIMIT 20""")
def raster_confusion_details(spark: SparkSession, sf: str) -> DataFrame:
    flagged = lambda least, scene: V.points(spark, sf).where((F.col("score") > least) & (F.col("scene") == scene)).select(F.floor(F.col("x") / 18).alias("ix"), F.floor(F.col("y") / 18).alias("iy")).distinct().withColumn("flag", F.lit(True))
    return raster.confusion_details(flagged(0.5, "click"), flagged(0.6, "view"))


@query(f"""WITH {V.CASES}, c AS (SELECT abs(mass_error * 1e9) AS m, cfl FROM cases WHERE status = 'completed') SELECT count(*) AS completed, round(quantile_cont(m, 0.5), 6) + 0.0 AS median_mass, round(max(m), 6) + 0.0 AS max_mass, round(max(cfl), 6) + 0.0 AS max_cfl FROM c""")
def ensemble_diagnostic_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble.diagnostic_bounds(V.cases(spark, sf).withColumn("mass_error", F.col("mass_error") * 1e9)))


@query(f"""WITH {V.CASES}, r AS (SELECT case_id // 2 * 2 AS case_id, count(*) AS n, min(CASE WHEN status = 'failed' THEN CASE WHEN case_id % 3 = 0 THEN 'unspecified' ELSE 'run ' || run_id END END) AS reason FROM cases GROUP BY 1), e AS (SELECT DISTINCT c_custkey AS case_id FROM customer)
SELECT coalesce(e.case_id, r.case_id) AS case_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN e.case_id IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' WHEN reason IS NOT NULL THEN 'failed' ELSE 'ok' END AS verdict, reason FROM e FULL JOIN r ON e.case_id = r.case_id""")
def ensemble_failure_reasons(spark: SparkSession, sf: str) -> DataFrame:
    expected = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))
    results = V.cases(spark, sf).withColumn("failure_reason", F.when(F.col("case_id") % 3 != 0, F.concat(F.lit("run "), F.col("run_id")))).withColumn("case_id", F.expr("case_id div 2 * 2"))
    return ensemble.reconcile_cases(expected, results)


@query("""WITH d AS (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_at) AS ix FROM d) SELECT user_id, string_agg(event_type, ',' ORDER BY ix) AS "values" FROM k WHERE ix <= 3 GROUP BY 1""")
def web_first_values(spark: SparkSession, sf: str) -> DataFrame:
    return web.first_values(table(spark, sf, "events"), "user_id", "event_type", "event_id", 3).withColumn("values", F.array_join("values", ","))


_SOURCE_STRINGS = r"""source AS (SELECT page_id, concat(html, ' "', url, '" "/observ/', page_id % 10, '" "obsCd=', page_id % 4, '"') AS html FROM pages), strings AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, '(?i)https?://[^"''\s)]+'), regexp_extract_all(html, '(?i)["''](/[^"'']*(?:api|observ|water|suii|river|kawabou|telemetry)[^"'']*)["'']', 1), regexp_extract_all(html, '(?i)["'']([^"'']*(?:obsCd|obsrvId|ofcCd|itmkndCd)[^"'']*)["'']', 1))) AS s FROM source),
found AS (SELECT DISTINCT page_id, trim(s) AS candidate FROM strings WHERE length(trim(s)) BETWEEN 3 AND 600)"""


def _fetches(spark: SparkSession, sf: str) -> DataFrame:
    source = F.concat(F.coalesce("html", F.lit("")), F.format_string(' "%s" "/observ/%d" "obsCd=%d"', "url", F.col("page_id") % 10, F.col("page_id") % 4))
    return table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("station"), F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("status"), web.candidate_strings(source, 1 << 30).alias("candidates"))


@query(f"WITH {_SOURCE_STRINGS} SELECT candidate, count(*) AS fetches FROM found GROUP BY 1")
def web_found_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return web.found_candidates(_fetches(spark, sf))


@query(f"""WITH {_SOURCE_STRINGS}, f AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS station, page_id % 7 <> 0 AS ok FROM pages), g AS (SELECT station, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS bad FROM f GROUP BY 1),
u AS (SELECT coalesce(string_agg(station, ',' ORDER BY station), '') AS unreachable FROM (SELECT station FROM g WHERE bad > 0 AND ok = 0 UNION ALL SELECT 'nowhere.example'))
SELECT CASE WHEN unreachable = '' THEN 'passed' ELSE 'partial' END AS status, unreachable, (SELECT count(*) FROM g) AS stations, (SELECT count(*) FROM g WHERE ok > 0) AS reached, (SELECT count(DISTINCT candidate) FROM found) AS candidates FROM u""")
def web_reach_report(spark: SparkSession, sf: str) -> DataFrame:
    f = _fetches(spark, sf)
    required = f.where("status = 404").select("station").union(spark.createDataFrame([("nowhere.example",)], "station string"))
    return web.reach_report(f, required).withColumn("unreachable", F.array_join("unreachable", ","))


@query(f"""WITH {V.MESH} SELECT cell_id, string_agg(o, ',' ORDER BY o) AS neighbours FROM (SELECT "left" AS cell_id, "right" AS o FROM edge WHERE n = 2 UNION ALL SELECT "right", "left" FROM edge WHERE n = 2) GROUP BY 1""")
def mesh_neighbour_lists(spark: SparkSession, sf: str) -> DataFrame:
    n = mesh.cell_neighbours(mesh.edge_incidence(V.mesh(spark, sf)[0]))
    return n.select("cell_id", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query("""WITH l AS (SELECT o_custkey AS "group", o_totalprice AS h, o_totalprice % 1000 AS error FROM orders), p AS (SELECT *, lead(h) OVER w AS h2, lead(error) OVER w AS e2 FROM l WINDOW w AS (PARTITION BY "group" ORDER BY h DESC))
SELECT "group", round(h, 4) + 0.0 AS h, round(CASE WHEN h > h2 AND h2 > 0 AND error > 0 AND e2 > 0 THEN ln(error / e2) / ln(h / h2) END, 4) + 0.0 AS "order" FROM p""")
def series_convergence_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("group"), F.col("o_totalprice").alias("h"), (F.col("o_totalprice") % 1000).alias("error"))
    return rounded(series.convergence_orders(o).select("group", "h", "order"), 4)


@query(f"""WITH {V.RUNS}, {V.PIXELS}, {V.POINTS} SELECT id FROM points WHERE (round_even(y / 2, 0)::INT, round_even(x, 0)::INT) IN (SELECT row, x FROM pixels)""")
def raster_points_half_even(spark: SparkSession, sf: str) -> DataFrame:
    p = V.points(spark, sf).select("id", "x", (F.col("y") / 2).alias("y"))
    return raster.point_in_runs(p, raster.merged_runs(V.runs(spark, sf)), "x", "y", "half_even").select("id")


@query(f"""WITH {V.POINTS} SELECT id, round(33.85 + id % 500 / 10000.0, 6) + 0.0 AS lat, round(130.65 + id % 700 / 10000.0, 6) + 0.0 AS lng FROM points""")
def geo_mercator_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    p = V.points(spark, sf).select("id", (33.85 + F.col("id") % 500 / 10000.0).alias("lat"), (130.65 + F.col("id") % 700 / 10000.0).alias("lng"))
    lat, lng = geo.web_mercator_inverse(*geo.web_mercator(F.col("lat"), F.col("lng")))
    return rounded(p.select("id", lat.alias("lat"), lng.alias("lng")))


@query("""WITH e AS (SELECT n_nationkey AS code, n_name AS name, r_name AS river, CASE WHEN n_nationkey % 3 > 0 THEN n_name || ' ' || r_regionkey END AS address FROM nation JOIN region ON r_regionkey = n_regionkey),
p AS (SELECT c_nationkey AS code, c_name || CASE WHEN c_custkey % 4 = 0 THEN ' ' || n_name || ' ' || n_regionkey ELSE '' END || CASE WHEN c_custkey % 6 = 0 AND c_nationkey % 5 > 0 THEN ' ' || r_name ELSE '' END AS t FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_nationkey <> 7)
SELECT e.code, coalesce(bool_or(contains(t, name)), false) AS name_found, coalesce(bool_or(contains(t, river)), false) AS river_found, coalesce(bool_or(contains(t, address)), false) AS address_found, coalesce(bool_or(contains(t, name) AND contains(t, river)), false) AS ok FROM e LEFT JOIN p ON p.code = e.code GROUP BY 1""")
def quality_payload_identity(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    expected = n.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("river"), F.when(F.col("n_nationkey") % 3 > 0, F.concat("n_name", F.lit(" "), "r_regionkey")).alias("address"))
    c = table(spark, sf, "customer").where("c_nationkey <> 7").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    named = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" "), "n_name", F.lit(" "), "n_regionkey")).otherwise("")
    river = F.when((F.col("c_custkey") % 6 == 0) & (F.col("c_nationkey") % 5 > 0), F.concat(F.lit(" "), "r_name")).otherwise("")
    return quality.payload_identity(c.select(F.col("c_nationkey").alias("code"), F.concat("c_name", named, river).alias("text")), expected)
