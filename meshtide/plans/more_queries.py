"""Registered queries of rules, small maps, tiles, patches and parameters, beside those of ``queries``."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtide.functions import flow, geo, scalar
from meshtide.operators import ensemble, graph, mesh, pieces, quality, raster, series, sites, spatial, web
from meshtide.plans import views as V
from meshtide.plans.queries import _RULES, ORACLE_SQL, query, rounded
from meshtide.session import shared_dir, table
from meshtide.sources import tables
from meshtide.streaming import stateful

_WALLS = [(200.31, 150.77, 610.53, 480.19), (90.11, 820.37, 930.71, 640.93)]
_WALLS_SQL = "walls(ax, ay, bx, by_) AS (VALUES " + ", ".join(map(str, _WALLS)) + ")"
_CROSSED = """turns AS (SELECT id, (qx - px) * (ay - py) - (qy - py) * (ax - px) AS t1, (qx - px) * (by_ - py) - (qy - py) * (bx - px) AS t2, (bx - ax) * (py - ay) - (by_ - ay) * (px - ax) AS t3, (bx - ax) * (qy - ay) - (by_ - ay) * (qx - ax) AS t4 FROM paths, walls),
crossed AS (SELECT DISTINCT id FROM turns WHERE t1 * t2 < 0 AND t3 * t4 < 0)"""


def _walls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_WALLS, "ax double, ay double, bx double, by double")


@query(f"""WITH {V.POINTS}, {_WALLS_SQL}, paths AS (SELECT id, x AS px, y AS py, x + score * 50 AS qx, y + 20 AS qy FROM points), {_CROSSED} SELECT id FROM crossed""")
def spatial_blocked_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = V.points(spark, sf).select("id", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("x") + F.col("score") * 50).alias("qx"), (F.col("y") + 20).alias("qy"))
    return spatial.blocked_paths(p, _walls(spark)).select("id")


@query(f"""WITH {V.POINTS}, {_WALLS_SQL}, rules(ax, ay, bx, by_, buffer) AS (VALUES {", ".join(map(str, _RULES))}), paths AS (SELECT id, x + 30 AS px, y AS py, x AS qx, y AS qy FROM points), {_CROSSED},
ends AS (SELECT id, x, y FROM points UNION ALL SELECT id, x + 30, y FROM points),
near AS (SELECT *, CASE WHEN (bx - ax) ** 2 + (by_ - ay) ** 2 = 0 THEN 0 ELSE least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) END AS t FROM ends, rules),
excluded AS (SELECT DISTINCT id FROM near WHERE sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2) <= buffer)
SELECT scene, id, row_number() OVER (PARTITION BY scene ORDER BY score DESC, id) AS "rank", floor(score * 100 + 0.5)::BIGINT AS score100 FROM points WHERE id NOT IN (SELECT id FROM crossed) AND id NOT IN (SELECT id FROM excluded)""")
def spatial_safe_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    spots = V.points(spark, sf).select("scene", "id", F.col("x").alias("tx"), F.col("y").alias("ty"), (F.col("x") + 30).alias("sx"), F.col("y").alias("sy"), "score")
    safe = spatial.safe_hotspots(spots, spark.createDataFrame(_RULES, "ax double, ay double, bx double, by double, buffer double"), _walls(spark))
    return safe.select("scene", "id", F.col("rank").cast("long").alias("rank"), "score100")


@query("""WITH r AS (SELECT l_suppkey AS id, avg(l_discount) AS d, count(*) AS n FROM lineitem WHERE l_suppkey % 7 > 0 GROUP BY 1)
SELECT s_suppkey AS id, CASE WHEN r.id IS NULL THEN 'missing' WHEN s_nationkey % 3 <> s_suppkey % 3 THEN 'invalid' WHEN d <= 0.0500123 AND n BETWEEN 10 AND 100000 THEN 'passed' ELSE 'failed' END AS status FROM supplier LEFT JOIN r ON r.id = s_suppkey WHERE s_suppkey % 2 = 0""")
def quality_evaluate_registry(spark: SparkSession, sf: str) -> DataFrame:
    rule = lambda metric, operator, target, high: F.struct(F.lit(metric).alias("metric"), F.lit(operator).alias("operator"), F.lit(target).alias("target"), F.lit(high).alias("high"))
    named = lambda k: F.concat(F.lit("p"), k % 3)
    k = F.col("s_suppkey")
    registry = table(spark, sf, "supplier").select(k.alias("id"), named(F.col("s_nationkey")).alias("purpose"), F.array(F.when(k % 2 == 0, "even").otherwise("odd")).alias("required_for"), F.array(rule("discount", "lte", 0.0500123, 0.0), rule("rows", "between", 10.0, 100000.0)).alias("criteria"))
    li = table(spark, sf, "lineitem").where("l_suppkey % 7 > 0").groupBy(F.col("l_suppkey").alias("id")).agg(F.create_map(F.lit("discount"), F.avg("l_discount"), F.lit("rows"), F.count(F.lit(1)).cast("double")).alias("metrics"))
    return quality.evaluate_registry(registry, li.withColumn("purpose", named(F.col("id"))), "even")


@query("""WITH c AS (SELECT l_orderkey AS kind, l_linenumber - 1 AS start FROM lineitem WHERE (l_orderkey * 8 + l_linenumber) % 23 > 0), w AS (SELECT kind, start, start <> coalesce(lag(start + 1) OVER (PARTITION BY kind ORDER BY start), 0) AS gap FROM c),
g AS (SELECT kind, count(*) FILTER (gap) AS gaps, max(start + 1) AS covered FROM w GROUP BY 1), t AS (SELECT l_orderkey AS kind, max(l_linenumber) AS total FROM lineitem GROUP BY 1)
SELECT t.kind, coalesce(gaps, 0) AS gaps, coalesce(covered, 0)::BIGINT AS covered, coalesce(gaps = 0 AND covered = total, false) AS complete FROM t LEFT JOIN g ON g.kind = t.kind""")
def series_chunk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    chunks = li.where("(l_orderkey * 8 + l_linenumber) % 23 > 0").select(F.col("l_orderkey").alias("kind"), (F.col("l_linenumber") - 1).cast("long").alias("start"), F.lit(1).cast("long").alias("count"))
    return series.chunk_coverage(chunks, li.groupBy(F.col("l_orderkey").alias("kind")).agg(F.max("l_linenumber").cast("long").alias("total")))


@query(f"""{ORACLE_SQL["series_interpolate_at"].replace("SELECT series_id, t, round", "SELECT series_id, t, 2.5::DOUBLE AS fixed, round")}""")
def series_parameter(spark: SparkSession, sf: str) -> DataFrame:
    s = V.series(spark, sf)
    rows = series.with_parameter(s.where("flag = 'click'").select("series_id", (F.col("t") + 600).alias("t")), "fixed", 2.5)
    return rounded(series.with_parameter(rows, "value", s.where("flag <> 'click'").select("series_id", "t", "value")))


@query("""WITH r AS (SELECT (l_partkey % 512)::INT AS row, (l_suppkey * 7)::INT AS x0, (l_suppkey * 7 + l_quantity % 5 - 1)::INT AS x1, row_number() OVER (PARTITION BY l_partkey % 512 ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS run_ix FROM lineitem),
w AS (SELECT row, run_ix, CASE WHEN row >= 500 OR x1 >= 660 THEN 'range' WHEN x1 < x0 THEN 'reversed' WHEN x0 <= lag(x1) OVER (PARTITION BY row ORDER BY run_ix) THEN 'overlap' END AS reason FROM r) SELECT * FROM w WHERE reason IS NOT NULL""")
def raster_run_validity(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "lineitem").select((F.col("l_partkey") % 512).cast("int").alias("row"), (F.col("l_suppkey") * 7).cast("int").alias("x0"), (F.col("l_suppkey") * 7 + F.col("l_quantity") % 5 - 1).cast("int").alias("x1"), F.row_number().over(W.partitionBy(F.col("l_partkey") % 512).orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")).cast("long").alias("run_ix"))
    return raster.run_validity(r, 660, 500).select("row", "run_ix", "reason")


@query(f"""WITH {V.RUNS}, {V.PIXELS}, i AS (SELECT half, row, x, x - row_number() OVER (PARTITION BY half, row ORDER BY x) AS k FROM pixels) SELECT half, row, min(x) AS x0, max(x) AS x1 FROM i GROUP BY half, row, k""")
def raster_tiled_runs(spark: SparkSession, sf: str) -> DataFrame:
    return raster.merged_runs(V.runs(spark, sf), keys=("half", "row"))


@query(f"""WITH {V.RUNS}, {V.PIXELS}, patch AS (SELECT row, x FROM pixels WHERE half = 1 AND row % 3 = 0), q AS (FROM patch UNION SELECT row, x FROM pixels WHERE half = 0 AND row NOT IN (SELECT row FROM patch)),
i AS (SELECT row, x, x - row_number() OVER (PARTITION BY row ORDER BY x) AS k FROM q) SELECT row, min(x) AS x0, max(x) AS x1 FROM i GROUP BY row, k""")
def raster_patched_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = V.runs(spark, sf)
    return raster.patched_runs(r.where("half = 0"), r.where("half = 1 and row % 3 = 0"))


@query(f"""WITH {V.RUNS}, {V.PIXELS}, a AS (SELECT row, x FROM pixels WHERE half = 0), b AS (SELECT row, x FROM pixels WHERE half = 1)
SELECT (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS added, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS removed, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) = 0 AS additive""")
def raster_only_added(spark: SparkSession, sf: str) -> DataFrame:
    r = V.runs(spark, sf)
    return raster.only_added(r.where("half = 0"), r.where("half = 1"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, list_sort([{'k': -l_discount * 10, 'i': 0, 'n': 'a'}, {'k': -l_tax * 10, 'i': 1, 'n': 'b'}, {'k': -l_quantity / 50, 'i': 2, 'n': 'c'}]) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, s[1].n || s[2].n || s[3].n AS labels FROM l""")
def flow_ranked_labels(spark: SparkSession, sf: str) -> DataFrame:
    ranked = flow.ranked_labels({"a": F.col("l_discount") * 10, "b": F.col("l_tax") * 10, "c": F.col("l_quantity") / 50})
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(ranked, lambda x: x["label"]), "").alias("labels"))


@query("""WITH f AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1)
SELECT l_orderkey, coalesce(array_to_string(list_filter(['A', 'N', 'X'], lambda x: NOT list_contains(f, x)), ','), '') AS missing, coalesce(array_to_string(list_sort(list_filter(f, lambda x: NOT list_contains(['A', 'N', 'X'], x))), ','), '') AS unexpected FROM f""")
def quality_key_differences(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    missing, unexpected = quality.key_differences(F.col("f"), F.array(*[F.lit(k) for k in "ANX"]))
    return f.select("l_orderkey", F.array_join(missing, ",").alias("missing"), F.array_join(F.sort_array(unexpected), ",").alias("unexpected"))


@query("""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN floor(epoch_us(ts) / 1e6) - 32400 END AS iso, (floor(epoch_us(ts) / 6e7) * 60)::DOUBLE AS minutes FROM events""")
def text_times(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    plain = F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    iso = F.when(F.col("event_id") % 3 > 0, F.concat(plain, F.lit("+09:00"))).otherwise(plain)
    return e.select("event_id", scalar.parse_iso_with_zone(iso).alias("iso"), scalar.parse_multi_format(F.date_format("ts", "yyyy/MM/dd HH:mm")).cast("double").alias("minutes"))


_COLOURS = [(0, 10, 20), (100, 200, 50), (255, 0, 255)]
_CHANNEL = "round_even(CASE WHEN k = 0 THEN {0} + ({1} - {0}) * (t - k) ELSE {1} + ({2} - {1}) * (t - k) END, 0)::INT AS {3}"


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, least(1::DOUBLE, greatest(0::DOUBLE, (l_discount - 0) / (0.1::DOUBLE - 0))) * 2 AS t FROM lineitem), q AS (SELECT *, least(floor(t), 1) AS k FROM p)
SELECT l_orderkey, l_linenumber, {", ".join(_CHANNEL.format(*[float(c[i]) for c in _COLOURS], n) for i, n in enumerate(("red", "green", "blue")))} FROM q""")
def scalar_palette(spark: SparkSession, sf: str) -> DataFrame:
    rgb = scalar.palette(F.col("l_discount"), F.lit(0.0), F.lit(0.1), _COLOURS)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[rgb[k].alias(n) for k, n in enumerate(("red", "green", "blue"))])


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE l_linenumber % 5 WHEN 0 THEN l_quantity <= 25 WHEN 1 THEN l_quantity >= 25 WHEN 2 THEN l_quantity = 25 WHEN 3 THEN l_quantity BETWEEN 25 AND 30 END, false) AS ok,
round((l_extendedprice * 0.00104719755::DOUBLE - l_quantity - l_tax * 100) / greatest(1, l_quantity, l_extendedprice * 0.00104719755::DOUBLE, l_tax * 100), 8) + 0.0 AS error FROM lineitem""")
def quality_criteria(spark: SparkSession, sf: str) -> DataFrame:
    operator = F.element_at(F.array(*[F.lit(k) for k in ("lte", "gte", "eq", "between", "other")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    ok = scalar.criterion(F.col("l_quantity"), operator, F.lit(25.0), F.lit(30.0))
    error = quality.conservation_error(F.col("l_quantity"), F.col("l_extendedprice") * 0.00104719755, F.col("l_tax") * 100)
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(ok, F.lit(False)).alias("ok"), error.alias("error")), 8)


@query(f"""WITH {V.POINTS}, p AS (SELECT id, x, y, 33.85 + id % 500 / 10000.0 AS lat, 130.65 + id % 700 / 10000.0 AS lng FROM points)
SELECT id, round(0.5 * x - 0.25 * y + 3, 6) + 0.0 AS sx, round(0.25 * x + 0.5 * y - 7, 6) + 0.0 AS sy, round(0.96 * x + 0.28 * y + 10, 6) + 0.0 AS tx, round(-0.28 * x + 0.96 * y + 10, 6) + 0.0 AS ty,
round((lng - 130.68) * 111320 * cos(radians(33.87)), 6) + 0.0 AS lx, round((lat - 33.87) * 110540, 6) + 0.0 AS ly, lat - 33.85 < 0.00022 OR 33.8999 - lat < 0.00022 OR lng - 130.65 < 0.00032 OR 130.7199 - lng < 0.00032 AS edge FROM p""")
def geo_local_maps(spark: SparkSession, sf: str) -> DataFrame:
    p = V.points(spark, sf).select("id", "x", "y", (33.85 + F.col("id") % 500 / 10000.0).alias("lat"), (130.65 + F.col("id") % 700 / 10000.0).alias("lng"))
    x, y, lat, lng = (F.col(c) for c in ("x", "y", "lat", "lng"))
    named = {"s": geo.similarity(x, y, 0.5, 0.25, 3.0, -7.0), "t": geo.two_point_similarity(x, y, ((0, 0), (3, 4)), ((10, 10), (14, 13))), "l": geo.local_xy(lat, lng, 33.87, 130.68)}
    return rounded(p.select("id", *[v.alias(f"{k}{n}") for k, xy in named.items() for n, v in zip("xy", xy, strict=True)], geo.near_map_edge(lat, lng, 33.85, 33.8999, 130.65, 130.7199).alias("edge")))


@query(f"WITH {V.GRAPH} SELECT round(sum(value * (node_id % 7)), 4) + 0.0 AS integral FROM nodes")
def graph_integral(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.integral(V.nodes(spark, sf).withColumn("weight", (F.col("node_id") % 7).cast("double"))), 4)


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def web_distinct_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return web.distinct_in_order(table(spark, sf, "events"), "user_id", "event_type", "event_id")


@query(f"""WITH {V.MESH}, o AS (SELECT avg(x) AS ox, avg(y) AS oy FROM vert) SELECT vertex_id, round_even((x - ox) * 1000, 0)::INT AS qx, round_even((y - oy) * 1000, 0)::INT AS qy FROM vert, o""")
def mesh_quantised(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.quantised(V.mesh(spark, sf)[1]).select("vertex_id", "qx", "qy")


@query("""WITH r AS (SELECT c_nationkey % 5 AS tier, sum(c_acctbal) AS wall FROM customer GROUP BY 1), t AS (SELECT r_regionkey AS tier, lead(r_regionkey) OVER (ORDER BY r_regionkey) AS next FROM region), m AS (SELECT avg(wall) AS m FROM r)
SELECT t.tier, coalesce(wall <= m, false) AS passed, CASE WHEN wall <= m THEN next END AS next_tier FROM t LEFT JOIN r ON r.tier = t.tier, m""")
def quality_tier_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    results = table(spark, sf, "customer").groupBy((F.col("c_nationkey") % 5).alias("tier")).agg(F.sum("c_acctbal").alias("wall_s"))
    tiers = table(spark, sf, "region").select(F.col("r_regionkey").alias("tier"), F.col("r_regionkey").alias("ix")).crossJoin(F.broadcast(results.agg(F.avg("wall_s").alias("limit_s"))))
    return quality.tier_evaluation(results, tiers)


@query("""WITH c AS (SELECT l_suppkey AS candidate, l_returnflag AS objective, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2), w(objective, weight) AS (VALUES ('A', 3), ('N', 2), ('R', 1), ('X', 1)),
v AS (SELECT s.candidate, weight, CASE WHEN d > 0.0512345 THEN 1.0::DOUBLE WHEN d > 0.0487654 THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS v FROM (SELECT DISTINCT candidate FROM c) s CROSS JOIN w LEFT JOIN c ON c.candidate = s.candidate AND c.objective = w.objective),
s AS (SELECT candidate, round(sum(v * weight) / sum(weight), 9) + 0.0 AS score, count(*) FILTER (v = 0) AS unmet, count(*) FILTER (v = 0.35) AS partial FROM v GROUP BY 1) SELECT *, rank() OVER (ORDER BY score DESC) AS "rank" FROM s""")
def quality_suitability(spark: SparkSession, sf: str) -> DataFrame:
    d = F.avg("l_discount")
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("candidate"), F.col("l_returnflag").alias("objective")).agg(F.when(d > 0.0512345, "full").when(d > 0.0487654, "partial").otherwise("none").alias("capability"))
    r = quality.suitability(c, spark.createDataFrame([("A", 3.0), ("N", 2.0), ("R", 1.0), ("X", 1.0)], "objective string, weight double"))
    return rounded(r.drop("unmet_objectives", "partial_objectives"), 9)


def _balance(rows: pd.DataFrame) -> pd.DataFrame:
    """A user's function for one case: refuses every fifth nation."""
    nation = int(rows["case_id"].iloc[0])
    if nation % 5 == 0:
        raise ValueError(f"nation {nation}")
    return pd.DataFrame({"case_id": [nation], "total": [rows["balance"].sum()]})


@query("""SELECT c_nationkey AS case_id, CASE WHEN c_nationkey % 5 > 0 THEN round(sum(c_acctbal), 2) + 0.0 END AS total, CASE WHEN c_nationkey % 5 > 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN c_nationkey % 5 = 0 THEN 'ValueError: nation ' || c_nationkey END AS failure_reason FROM customer GROUP BY 1""")
def ensemble_user_function(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("case_id"), F.col("c_acctbal").alias("balance"))
    return rounded(ensemble.run_ensemble(c, _balance, "case_id long, total double"), 2)


@query(f"""WITH e AS (SELECT user_id AS cell, ts, value AS h FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
w AS (SELECT *, coalesce(last_value(CASE WHEN h >= 60 THEN 1 WHEN h <= 20 THEN 0 END IGNORE NULLS) OVER (PARTITION BY cell ORDER BY ts, h ROWS UNBOUNDED PRECEDING), 0) AS wet FROM e),
c AS (SELECT cell, ts, wet, lag(wet) OVER (PARTITION BY cell ORDER BY ts, h) AS before FROM w)
SELECT cell, epoch_us(ts) AS us, wet::INT AS wet, CASE WHEN wet > before THEN 'wetting' WHEN wet < before THEN 'drying' END AS change FROM c WHERE epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 3600000 FROM e)""")
def stream_wet_dry(spark: SparkSession, sf: str) -> DataFrame:
    """All events as a stream, in the order of their time; what the watermark of an hour has passed has been handed on when the stream ends."""
    kind = table(spark, sf, "events").schema
    events = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf)
    depths = events.select(F.col("user_id").alias("cell"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("h"))
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stateful.stream_hysteresis(depths, 60, 20).writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{at}/state").start(f"{at}/rows")
    q.awaitTermination()
    r = spark.read.schema("cell long, ts timestamp, wet int, change string").parquet(f"{at}/rows")
    return r.select("cell", F.unix_micros("ts").alias("us"), "wet", "change").where(F.floor(F.col("us") / 1000) < F.lit(table(spark, sf, "events").agg(F.unix_millis(F.max(F.col("ts").cast("timestamp")))).first()[0] - 3_600_000))


_LABELS = """cc(node, component) USING KEY (node) AS (SELECT node, node FROM node UNION
(SELECT u.node, min(v.component) FROM recurring.cc u JOIN link e ON e.src = u.node JOIN cc v ON v.node = e.dst WHERE v.component < u.component GROUP BY u.node))"""

_BARRAGE = (-1.0, 20.2, 60.0, 24.9)
_CUT_SQL = f"""cen AS (SELECT cell_id, (p.x + q.x + r.x) / 3 AS x, (p.y + q.y + r.y) / 3 AS y FROM tri JOIN vert p ON p.vertex_id = a JOIN vert q ON q.vertex_id = b JOIN vert r ON r.vertex_id = c),
side AS (SELECT cell_id, ({_BARRAGE[2]} - {_BARRAGE[0]}) * (y - {_BARRAGE[1]}) - ({_BARRAGE[3]} - {_BARRAGE[1]}) * (x - {_BARRAGE[0]}) > 0 AS above FROM cen),
node AS (SELECT cell_id AS node FROM tri), pair AS (SELECT "left" AS src, "right" AS dst FROM edge JOIN side s ON s.cell_id = "left" JOIN side t ON t.cell_id = "right" WHERE n = 2 AND s.above = t.above AND (lo * 1000000 + hi) % 41 > 0),
link AS (FROM pair UNION ALL SELECT dst, src FROM pair)"""


def _banks(spark: SparkSession, sf: str) -> DataFrame:
    """``cell_id, x, y, component`` of the mesh, cut along a line and at every face whose number 41 divides."""
    tri, v = V.mesh(spark, sf)
    cells = mesh.triangle_geometry(tri, v)
    c = lambda k, p: cells.select(F.col("cell_id").alias(k), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    f = mesh.face_geometry(mesh.edge_incidence(tri), v, cells).where("kind = 'interior'").join(c("left", "l"), "left").join(c("right", "r"), "right")
    f = f.select((F.col("lo") * 1_000_000 + F.col("hi")).alias("face_id"), "left", "right", "lx", "ly", "rx", "ry", "mx", "my")
    gone = mesh.cut_faces(f, _BARRAGE, f.where("face_id % 41 = 0"))
    return mesh.cut_components(cells, f, gone)


@query(f"WITH RECURSIVE {V.MESH}, {_CUT_SQL}, {_LABELS} SELECT node AS cell_id, component FROM cc")
def mesh_cut_components(spark: SparkSession, sf: str) -> DataFrame:
    return _banks(spark, sf).select("cell_id", "component")


@query(f"""WITH RECURSIVE {V.MESH}, {_CUT_SQL}, {_LABELS}, b AS (SELECT node AS cell_id, x, y, component FROM cc JOIN cen ON cell_id = node), two AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) AS k FROM b GROUP BY 1 QUALIFY k <= 2),
s AS (SELECT n_nationkey AS id, n_nationkey * 2.0 AS x, 22.0 + n_nationkey * 0.05 AS y, n_nationkey * 1.5 AS bearing FROM nation),
d AS (SELECT id, cell_id, k, b.x - s.x AS dx, b.y - s.y AS dy, bearing, (b.x - s.x) * sin(radians(bearing)) - (b.y - s.y) * cos(radians(bearing)) AS along FROM s, b JOIN two USING (component))
SELECT id, coalesce(arg_min(cell_id, {{'a': sqrt(dx * dx + dy * dy), 'b': cell_id}}) FILTER (k = 1 AND along < 0), -1) AS behind FROM d GROUP BY id""")
def sites_behind_barrage(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest cell behind each site on the larger bank of the cut mesh."""
    cells = _banks(spark, sf)
    largest = cells.groupBy("component").count().orderBy(F.desc("count"), "component").limit(2).collect()  # two rows
    k = F.col("n_nationkey")
    s = table(spark, sf, "nation").select(k.alias("id"), (k * 2.0).alias("x"), (k * 0.05 + 22.0).alias("y"), (k * 1.5).alias("bearing"), F.lit(largest[0]["component"]).alias("up"), F.lit(largest[-1]["component"]).alias("down"))
    return sites.opposite_side_pair(s, cells).select("id", F.coalesce("behind", F.lit(-1)).alias("behind"))


@query(f"""WITH RECURSIVE {V.POINTS}, c AS (SELECT scene, id, x, y, score, row_number() OVER (PARTITION BY scene ORDER BY score DESC, id) AS k FROM points),
g AS (SELECT scene, [{{'x': x, 'y': y, 'id': id, 'score': score}}] AS kept, 1::BIGINT AS k FROM c WHERE k = 1
UNION ALL SELECT scene, kept, k FROM (SELECT g.scene, list_append(g.kept, {{'x': c.x, 'y': c.y, 'id': c.id, 'score': c.score}}) AS kept, c.k, row_number() OVER (PARTITION BY g.scene ORDER BY c.k) AS first
 FROM g JOIN c ON c.scene = g.scene AND c.k > g.k WHERE len(g.kept) < 8 AND len([1 FOR q IN g.kept IF sqrt((q.x - c.x) ** 2 + (q.y - c.y) ** 2) < 150]) = 0) WHERE first = 1),
w AS (SELECT scene, arg_max(kept, len(kept)) AS kept FROM g GROUP BY 1)
SELECT scene, q.id AS id, round(q.score, 6) + 0.0 AS score, rank FROM (SELECT scene, unnest(kept) AS q, unnest(range(1, len(kept) + 1)) AS rank FROM w)""")
def spatial_points_apart(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.points_apart(V.points(spark, sf)))


@query(f"""WITH {V.POINTS} SELECT DISTINCT floor(x / 18)::BIGINT AS ix, floor(y / 18)::BIGINT AS iy FROM points WHERE score > 0.035""")
def raster_rings_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Cells to outlines, closed rings, GeoJSON polygons with holes, and back to cells."""
    c = V.points(spark, sf).where("score > 0.035").select(F.floor(F.col("x") / 18).alias("ix"), F.floor(F.col("y") / 18).alias("iy")).distinct()
    corners = raster.outline_rings(c).withColumns({"kind": F.lit("water_polygon"), "geom_type": F.lit("Polygon")})
    features = tables.parsed_features(tables.geojson_features(corners))
    runs = raster.cells_of_rings(tables.closed_segments(tables.rings(features)))
    return runs.select(F.explode(F.sequence("x0", "x1")).alias("ix"), F.col("row").cast("long").alias("iy"))


_RUN_LIMITS = {"cases": 3000, "completed_fraction": 0.95, "nan_count": 0, "negative_count": 5, "cfl": 0.95, "mass": 1e-8, "wall": 7200, "memory": 8192}
_SPOILT = {"1-URGENT": "max_cfl", "2-HIGH": "wall_total", "3-MEDIUM": "completed", "5-LOW": "sim_min"}
_STATED = ("cases", "completed", "failed", "wall_total", "max_cfl", "max_mass", "sim_min", "sim_max")
_ACCEPT = [("attempted", "cases", "cases = 3000", 3000), ("completed_fraction", "completed / 3000", "completed / 3000 >= 0.95", 0.95), ("failed", "failed", "failed = 0", 0), ("nan_count", "nan_count", "nan_count <= 0", 0), ("negative_count", "negative_count", "negative_count <= 5", 5),
           ("cfl", "max_cfl", "max_cfl <= 0.95", 0.95), ("mass", "max_mass", "max_mass <= 1e-8", 1e-8), ("wall", "wall_s", "wall_s <= 7200", 7200), ("memory", "memory", "memory <= 8192", 8192), ("min_depth", "min_depth", "min_depth >= 0", 0), ("unchanged", "1", "true", 1)]
_EXTREMES = "count(*)::DOUBLE AS cases, count(*) FILTER (done)::DOUBLE AS completed, count(*) FILTER (NOT done)::DOUBLE AS failed, fsum(wall_s) AS wall_total, max(cfl) FILTER (done) AS max_cfl, max(abs(mass_error)) FILTER (done) AS max_mass, min(sim_s) FILTER (done) AS sim_min, max(sim_s) FILTER (done) AS sim_max"
_EQUAL = "abs(own.{0} - rep.{0}) <= 8 * power(2, -52) * greatest(1, abs(own.{0}), abs(rep.{0}))"


@query(f"""WITH {V.CASES}, c AS (SELECT *, status = 'completed' AS done, wall_s * 250 + 1 AS sim_s FROM cases), own AS (SELECT run_id, {_EXTREMES}, count(*) FILTER (min_depth < 0) AS negative_count, min(min_depth) AS min_depth FROM c GROUP BY 1),
rep AS (SELECT run_id, {", ".join(f"{k} * CASE run_id {' '.join(f"WHEN '{r}' THEN 1.001" for r, x in _SPOILT.items() if x == k)} ELSE 1 END AS {k}" if k in _SPOILT.values() else k for k in _STATED)}, 0 AS nan_count, negative_count, min_depth, wall_total * 1.01 AS wall_s, 512 AS memory FROM own)
{" UNION ALL ".join([f"SELECT own.run_id, 'reported' AS kind, '{k}' AS name, round(own.{k}, 6) + 0.0 AS value, round(rep.{k}, 6) + 0.0 AS target, {_EQUAL.format(k)} AS ok FROM own JOIN rep USING (run_id)" for k in _STATED]
 + ["SELECT run_id, 'reported', 'wall_covers_cases', round(wall_s, 6) + 0.0, round(wall_total, 6) + 0.0, wall_s >= wall_total FROM rep"]
 + [f"SELECT run_id, 'accepted', '{k}', round(({v})::DOUBLE, 6) + 0.0, round({x}::DOUBLE, 6) + 0.0, {ok} FROM rep" for k, v, ok, x in _ACCEPT])}""")
def quality_report_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Every run's report, with one stated value spoilt in four of the five, against its cases and the limits."""
    c = V.cases(spark, sf).withColumn("sim_s", F.col("wall_s") * 250 + 1)
    done = F.col("status") == "completed"
    of = lambda f, x: f(F.when(done, F.col(x)))
    stated = {"cases": F.count(F.lit(1)).cast("double"), "completed": F.count_if(done).cast("double"), "failed": F.count_if(~done).cast("double"), "wall_total": scalar.exact_sum(F.col("wall_s")), "max_cfl": of(F.max, "cfl"), "max_mass": F.max(F.when(done, F.abs("mass_error"))), "sim_min": of(F.min, "sim_s"), "sim_max": of(F.max, "sim_s")}
    r = c.groupBy("run_id").agg(*[v.alias(k) for k, v in stated.items()], F.count_if(F.col("min_depth") < 0).alias("negative_count"), F.min("min_depth").alias("min_depth"))
    r = r.withColumns({"wall_s": F.col("wall_total") * 1.01, "nan_count": F.lit(0), "memory": F.lit(512), "unchanged": F.lit(True)})
    for run, name in _SPOILT.items():
        r = r.withColumn(name, F.when(F.col("run_id") == run, F.col(name) * 1.001).otherwise(F.col(name)))
    return rounded(quality.report_evaluation(c, r, _RUN_LIMITS).withColumnRenamed("check", "name"))


_HEADS = "l_extendedprice / 1e4 AS ha, l_quantity / 10 AS hb, ['disabled', 'fixed', 'orifice', 'gate'][(l_orderkey % 4 + 1)::BIGINT] AS mode, l_partkey % 50 AS a, l_suppkey % 50 AS b, l_discount AS opening, l_linenumber - 3.0 AS dx, l_tax * 10 AS dy, l_quantity / 25 AS speed"


@query(f"""WITH s AS (SELECT {_HEADS} FROM lineitem), q AS (SELECT *, CASE mode WHEN 'disabled' THEN 0 WHEN 'fixed' THEN 1.5 ELSE sign(ha - hb) * 0.6 * (CASE mode WHEN 'orifice' THEN 2.0 ELSE 3.0 * 1.5 * opening END) * sqrt(2 * 9.81 * abs(ha - hb)) END AS q, sqrt(dx * dx + dy * dy) AS n FROM s),
e AS (SELECT a, b, q, coalesce(abs(q) * speed * dx / nullif(n, 0), 0) AS px, coalesce(abs(q) * speed * dy / nullif(n, 0), 0) AS py FROM q WHERE a <> b)
SELECT cell_id, round(sum(m), 4) + 0.0 AS mass, round(sum(px), 4) + 0.0 AS momentum_x, round(sum(py), 4) + 0.0 AS momentum_y FROM (SELECT a AS cell_id, -q AS m, -px AS px, -py AS py FROM e UNION ALL SELECT b, q, px, py FROM e) GROUP BY 1""")
def graph_structure_sources(spark: SparkSession, sf: str) -> DataFrame:
    c, modes = F.col, F.array(*[F.lit(m) for m in ("disabled", "fixed", "orifice", "gate")])
    mode = F.get(modes, (c("l_orderkey") % 4).cast("int"))
    q = scalar.structure_discharge(mode, c("l_extendedprice") / 1e4, c("l_quantity") / 10, F.lit(0.6), F.lit(2.0), F.lit(3.0), F.lit(1.5), c("l_discount"), F.lit(1.5))
    s = table(spark, sf, "lineitem").select((c("l_partkey") % 50).alias("cell_a"), (c("l_suppkey") % 50).alias("cell_b"), q.alias("discharge"), (c("l_linenumber") - 3.0).alias("dir_x"), (c("l_tax") * 10).alias("dir_y"), (c("l_quantity") / 25).alias("speed"))
    return rounded(graph.structure_sources(s), 4)


ORACLE_SQL["mesh_locate_weights"] = ORACLE_SQL["mesh_locate"].replace("SELECT id, min(cell_id) AS cell_id FROM z", "SELECT id, min(cell_id) AS cell_id, arg_min(((bx - x) * (cy - y) - (by_ - y) * (cx - x)) / d, cell_id) AS wa, arg_min(((cx - x) * (ay - y) - (cy - y) * (ax - x)) / d, cell_id) AS wb FROM z").replace("SELECT id AS point_id, coalesce(cell_id, -1) AS cell_id FROM z", "SELECT id AS point_id, coalesce(cell_id, -1) AS cell_id, round(wa, 6) + 0.0 AS wa, round(wb, 6) + 0.0 AS wb, round(1 - wa - wb, 6) + 0.0 AS wc FROM z")


@query()
def mesh_locate_weights(spark: SparkSession, sf: str) -> DataFrame:
    p = V.points(spark, sf).select(F.col("id").alias("point_id"), (F.col("x") / 16).alias("x"), (F.col("y") / 40).alias("y"))
    return rounded(mesh.locate_in_mesh(p, *V.mesh(spark, sf), bucket=2.0, weights=True).withColumn("cell_id", F.coalesce("cell_id", F.lit(-1))))


@query("""WITH e AS (SELECT event_id AS step, value AS h, last_value(CASE WHEN value >= 60 THEN 1 WHEN value <= 20 THEN 0 END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS x FROM events), w AS (SELECT step, coalesce(x, 0) AS wet FROM e)
SELECT step, wet, coalesce(lag(wet) OVER o = 0 AND wet = 1, false) AS newly_wet, coalesce(lag(wet) OVER o = 1 AND wet = 0, false) AS newly_dry FROM w WINDOW o AS (ORDER BY step)""")
def series_one_long(spark: SparkSession, sf: str) -> DataFrame:
    """All events as one series, worked on in pieces of its order."""
    e = table(spark, sf, "events").select(F.lit(1).alias("cell"), F.col("event_id").alias("step"), F.col("value").alias("h"))
    return series.hysteresis(e, 60, 20, group_rows=1_000).select("step", "wet", "newly_wet", "newly_dry")


@query("SELECT l_returnflag AS flag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) + 0.0 AS {n}" for p, n in zip(ensemble.PROBABILITIES, ensemble.NAMES, strict=True)) + " FROM lineitem GROUP BY 1")
def ensemble_long_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles of three groups that hold all rows, in pieces of their values."""
    v = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").cast("double").alias("v"))
    p = pieces.grouped_percentiles(v, "flag", ensemble.PROBABILITIES, 1_000)
    return rounded(p.select("flag", *[F.col("p")[k].alias(n) for k, n in enumerate(ensemble.NAMES)]))


def _mean_balance(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"case_id": rows["case_id"].iloc[:1], "depth": rows["balance"].mean() - 4500})


@query("""WITH m AS (SELECT c_nationkey AS case_id, avg(c_acctbal) - 4500 AS depth FROM customer GROUP BY 1)
SELECT case_id, CASE WHEN depth >= 0 THEN round(depth, 2) + 0.0 END AS depth, CASE WHEN depth >= 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN depth < 0 THEN 'ValueError: negative depth' END AS failure_reason FROM m""")
def ensemble_validated_cases(spark: SparkSession, sf: str) -> DataFrame:
    """A user function for each nation, whose result counts only if it passes a rule."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("case_id"), F.col("c_acctbal").alias("balance"))
    return rounded(ensemble.run_ensemble(c, _mean_balance, "case_id long, depth double", rules={"negative depth": ensemble.FIELD_RULES["negative depth"]}), 2)
