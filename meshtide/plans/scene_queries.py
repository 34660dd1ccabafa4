"""Registered queries of the site, flow, grid and source jobs, beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtide.functions import flow, scalar
from meshtide.operators import graph, mesh, quality, raster, series, sites, spatial, web
from meshtide.plans import views as V
from meshtide.plans.queries import _POLY, _POLY_SQL, R, query, rounded
from meshtide.session import table
from meshtide.sources import tables
from meshtide.streaming import stateful

_POLY_TYPE = "feature int, ring int, ax double, ay double, bx double, by double"
_INSIDE = """inside AS (SELECT id, feature FROM (SELECT id, feature, ring, count(*) % 2 AS odd FROM {0}, poly WHERE (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / (by_ - ay) + ax GROUP BY 1, 2, 3) WHERE odd = 1 GROUP BY 1, 2 HAVING max((ring = 0)::INT) = 1 AND max((ring > 0)::INT) = 0)"""
_CORNERS = "corners AS (SELECT cell_id, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_, r.x AS cx, r.y AS cy, (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) AS d FROM tri JOIN vert p ON p.vertex_id = a JOIN vert q ON q.vertex_id = b JOIN vert r ON r.vertex_id = c)"
_W1, _W2 = "((bx - x) * (cy - y) - (by_ - y) * (cx - x)) / d", "((cx - x) * (ay - y) - (cy - y) * (ax - x)) / d"


@query(f"""WITH {V.MESH}, {V.POINTS}, {_CORNERS}, z AS (SELECT id, x / 16 AS x, y / 40 AS y FROM points),
w AS (SELECT id, cell_id, {_W1} AS w1, {_W2} AS w2 FROM z JOIN corners ON x BETWEEN least(ax, bx, cx) - 1e-6 AND greatest(ax, bx, cx) + 1e-6 AND y BETWEEN least(ay, by_, cy) - 1e-6 AND greatest(ay, by_, cy) + 1e-6),
f AS (SELECT id, min(cell_id) AS tri FROM w WHERE w1 BETWEEN -1e-7 AND 1 + 1e-7 AND w2 BETWEEN -1e-7 AND 1 + 1e-7 AND 1 - w1 - w2 BETWEEN -1e-7 AND 1 + 1e-7 GROUP BY 1)
SELECT id, round(CASE WHEN tri IS NULL THEN x ELSE x + tri % 3 END, 6) + 0.0 AS x, round(CASE WHEN tri IS NULL THEN y ELSE y - tri % 5 END, 6) + 0.0 AS y, coalesce(tri, -1) AS tri FROM z LEFT JOIN f USING (id)""")
def sites_piecewise_affine(spark: SparkSession, sf: str) -> DataFrame:
    t = mesh.with_corners(*V.mesh(spark, sf)).withColumn("tri", F.col("cell_id"))
    for u, k in zip("uvw", "abc", strict=True):
        t = t.withColumn(f"{u}x", F.col(f"{k}x") + F.col("tri") % 3).withColumn(f"{u}y", F.col(f"{k}y") - F.col("tri") % 5)
    p = V.points(spark, sf).select("id", (F.col("x") / 16).alias("x"), (F.col("y") / 40).alias("y"))
    return rounded(sites.piecewise_affine(p, t, 2.0).withColumn("tri", F.coalesce("tri", F.lit(-1))))


@query(f"""WITH {V.RUNS}, {V.POINTS}, p AS (SELECT id, x, y, x + score / 25 AS px, y - score / 50 AS py, scene = 'click' AS water FROM points),
w AS (SELECT *, EXISTS (SELECT 1 FROM runs r WHERE r.row = floor(p.y) AND floor(p.x) BETWEEN r.x0 AND r.x1) AS wet FROM p), a AS (SELECT count(*) AS n, max(sqrt((x - px) ** 2 + (y - py) ** 2)) AS e, count(*) FILTER (wet <> water) AS mismatches FROM w)
SELECT n, round(e, 6) + 0.0 AS max_error, mismatches, e <= 0.05 AND mismatches = 0 AS ok FROM a""")
def sites_control_points(spark: SparkSession, sf: str) -> DataFrame:
    p = V.points(spark, sf).select("id", "x", "y", (F.col("x") + F.col("score") / 25).alias("px"), (F.col("y") - F.col("score") / 50).alias("py"), F.when(F.col("scene") == "click", "water").otherwise("land").alias("semantic"))
    return rounded(sites.control_point_check(p, raster.merged_runs(V.runs(spark, sf))))


_BOXES = [(300.0, 300.0, 700.0, 420.0), (20.0, 550.0, 90.0, 950.0)]


@query(f"""WITH {V.POINTS}, {_POLY_SQL}, {_INSIDE.format("points")}, boxes(a, b, c, d) AS (VALUES {", ".join(map(str, _BOXES))})
SELECT id, CASE WHEN id IN (SELECT id FROM inside WHERE feature = 1) THEN false WHEN id IN (SELECT id FROM inside WHERE feature = 0) THEN true WHEN EXISTS (SELECT 1 FROM boxes WHERE x BETWEEN a - 1.5 AND c + 1.5 AND y BETWEEN b - 1.5 AND d + 1.5) THEN false ELSE score > 0.5 END AS state FROM points""")
def sites_land_water(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.createDataFrame(_POLY, _POLY_TYPE)
    boxes = spark.createDataFrame(_BOXES, "x0 double, y0 double, x1 double, y1 double")
    p = V.points(spark, sf).select("id", "x", "y", (F.col("score") > 0.5).alias("fallback"))
    return sites.land_water(p, e.where("feature = 1"), e.where("feature = 0"), boxes, 50.0, 1.5)


_OPENINGS = [("N", 3.0, 9.0, "top"), ("S", 8.0, 30.0, "bottom"), ("E", 28.0, 49.0, "bottom")]


@query(f"""WITH {V.MESH}, o(tag, x0, x1, side) AS (VALUES {", ".join(map(str, _OPENINGS))}), f AS (SELECT lo * 1000000 + hi AS face_id, (p.x + q.x) / 2 AS mx, (p.y + q.y) / 2 AS my FROM edge JOIN vert p ON p.vertex_id = lo JOIN vert q ON q.vertex_id = hi WHERE n = 1),
h AS (SELECT face_id, my, tag, side, CASE side WHEN 'top' THEN min(my) OVER (PARTITION BY tag) ELSE max(my) OVER (PARTITION BY tag) END AS outermost FROM f JOIN o ON mx BETWEEN x0 - 0.5 AND x1 + 0.5)
SELECT face_id, min(tag) AS tag, count(DISTINCT tag) > 1 AS overlaps FROM h WHERE abs(my - outermost) <= 0.75 GROUP BY 1""")
def sites_tagged_faces(spark: SparkSession, sf: str) -> DataFrame:
    tri, v = V.mesh(spark, sf)
    g = mesh.face_geometry(mesh.edge_incidence(tri).where("kind = 'boundary'"), v, mesh.triangle_geometry(tri, v))
    f = g.select((F.col("lo") * 1_000_000 + F.col("hi")).alias("face_id"), "mx", "my")
    return sites.tagged_faces(f, spark.createDataFrame(_OPENINGS, "tag string, x0 double, x1 double, side string"), 16.0)


_REGION = "s_suppkey AS region, 33.0 + s_suppkey % 100 * 0.01 AS south, 130.0 + s_suppkey // 100 * 0.01 AS west"


@query(f"""WITH g AS (SELECT {_REGION} FROM supplier), r AS (SELECT *, unnest(generate_series(0, floor((south + 0.004 - south) / (24 / 111320.0))::INT)) AS row FROM g),
l AS (SELECT *, south + row * (24 / 111320.0) AS lat, 24 / (111320.0 * cos(radians(south + row * (24 / 111320.0)))) AS dl FROM r), c AS (SELECT *, unnest(generate_series(0, floor((west + 0.004 - west) / dl)::INT)) AS col FROM l), p AS (SELECT *, west + col * dl AS lng FROM c)
SELECT region, row::INT AS row, col::INT AS col, round(lat, 8) + 0.0 AS lat, round(lng, 8) + 0.0 AS lng FROM p WHERE (south + 0.0001 > lat) <> (south + 0.0037 > lat) AND lng < west + 0.0039 - (lat - south - 0.0001) / 0.0036 * 0.0036 AND lng >= west + 0.0003""")
def sites_grid_samples(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    r = table(spark, sf, "supplier").select(k.alias("region"), (33.0 + k % 100 * 0.01).alias("south"), (130.0 + F.floor(k / 100) * 0.01).alias("west"))
    r = r.withColumn("north", F.col("south") + 0.004).withColumn("east", F.col("west") + 0.004)
    at = lambda dx, dy: (F.col("west") + dx, F.col("south") + dy)
    corners = [at(0.0003, 0.0001), at(0.0039, 0.0001), at(0.0003, 0.0037)]
    sides = [F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    e = r.select(F.col("region").alias("feature"), F.lit(0).alias("ring"), F.explode(F.array(*sides)).alias("s")).select("feature", "ring", "s.*")
    return rounded(sites.grid_samples(r, e, 24.0, 0.001), 8)


_DIST = "sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2)"
_TIER = "SELECT p.id AS target, s.id AS stand, {d} AS d, p.score * {w} AS weighted FROM {t} p JOIN points s ON abs(p.x - s.x) <= 6 AND abs(p.y - s.y) <= 6 WHERE s.scene = '{scene}' AND {d} <= 6 AND {d} >= 1.5 QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY weighted DESC, s.id) = 1"


@query(f"""WITH {V.POINTS}, t AS (SELECT * FROM points WHERE scene = 'click'), a AS ({_TIER.format(d=_DIST, t="t", scene="view", w=f"((0.66 + 0.34 * exp(-0.5 * (({_DIST} - 34) / 30) ** 2)) * CASE WHEN {_DIST} < 5 THEN 0.55 ELSE 1 END)")}),
u AS (SELECT * FROM t WHERE id NOT IN (SELECT target FROM a)), b AS ({_TIER.format(d=_DIST, t="u", scene="signup", w=f"(0.7 + 0.3 * exp(-0.5 * (({_DIST} - 35) / 32) ** 2))")})
SELECT target, stand, round(d, 6) + 0.0 AS d, round(weighted, 6) + 0.0 AS score, 0 AS tier FROM a UNION ALL SELECT target, stand, round(d, 6) + 0.0, round(weighted * 0.92, 6) + 0.0, 1 FROM b""")
def sites_tiered_stands(spark: SparkSession, sf: str) -> DataFrame:
    p = V.points(spark, sf)
    layers = [(p.where("scene = 'view'"), sites.near_stand_weight, 1.0), (p.where("scene = 'signup'"), sites.wide_stand_weight, 0.92)]
    return rounded(sites.tiered_stands(p.where("scene = 'click'"), layers, 6.0, 1.5)).select("target", "stand", "d", "score", "tier")


_LINES = [(k, i, float(x), float(y)) for k, line in enumerate((((0, 0), (400, 300), (900, 350)), ((0, 800), (500, 700), (1000, 990)))) for i, (x, y) in enumerate(line)]


@query(f"""WITH {V.POINTS}, v(line_id, ix, x, y) AS (VALUES {", ".join(map(str, _LINES))}), e AS (SELECT line_id, ix, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM v WINDOW w AS (PARTITION BY line_id ORDER BY ix)),
l AS (SELECT *, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS len FROM e WHERE bx IS NOT NULL), m AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY line_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(len) OVER (PARTITION BY line_id) AS total FROM l),
t AS (SELECT *, least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / len ** 2)) AS t FROM points, m), d AS (SELECT *, sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2) AS d, (start + t * len) / total AS progress FROM t),
n AS (SELECT *, 200 + 100 * line_id + 80 * progress AS width FROM d QUALIFY row_number() OVER (PARTITION BY id, line_id ORDER BY d, ix) = 1), k AS (SELECT *, d / (1.4 * width * 0.55) AS normalized FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY normalized, line_id) = 1)
SELECT id, line_id, {R("d")}, {R("progress")}, {R("width")}, {R("normalized")} FROM k""")
def sites_nearest_axis_normalized(spark: SparkSession, sf: str) -> DataFrame:
    m = spatial.polyline_measure(spark.createDataFrame(_LINES, "line_id int, ix int, x double, y double"))
    n = sites.nearest_axis_normalized(V.points(spark, sf), m, 200 + 100 * F.col("line_id") + 80 * F.col("progress"))
    return rounded(n.select("id", "line_id", "d", "progress", "width", "normalized"))


_RING = ", ".join(f"({i * 7 + j}, {r}, cos({i} * 0.22) * {r}, sin({i} * 0.22) * {r})" for i in range(29) for j, r in enumerate(sites.RADII))


@query(f"""WITH {V.POINTS}, {_POLY_SQL}, ring(k, r, dx, dy) AS (VALUES {_RING}), c AS (SELECT p.id AS target, p.id * 1000 + k AS id, k, r, x + dx AS x, y + dy AS y FROM points p, ring), {_INSIDE.format("c")},
o AS (SELECT *, abs(r - 70.0) + CASE WHEN sqrt((x - 500) ** 2 + (y - 400) ** 2) < 90 THEN 60 ELSE 0 END AS cost FROM c WHERE id NOT IN (SELECT id FROM inside) QUALIFY row_number() OVER (PARTITION BY target ORDER BY cost, k) = 1)
SELECT target AS id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, r::DOUBLE AS d, cost::DOUBLE AS cost FROM o""")
def sites_cast_ring(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sites.cast_candidate_ring(V.points(spark, sf), spark.createDataFrame(_POLY, _POLY_TYPE), 50.0, (500.0, 400.0)))


@query(f"""WITH {V.MESH}, {_CORNERS}, c AS (SELECT cell_id, (ax + bx + cx) / 3 AS x, (ay + by_ + cy) / 3 AS y FROM corners), s AS (SELECT n_nationkey AS id, n_nationkey * 2.0 AS x, n_nationkey * 0.5 + 1.0 AS y, n_nationkey * 14.5 AS bearing FROM nation),
j AS (SELECT id, cell_id, cell_id % 2 AS side, c.x - s.x AS dx, c.y - s.y AS dy, sin(radians(bearing)) * (c.x - s.x) - cos(radians(bearing)) * (c.y - s.y) AS along, bearing FROM s, c),
b AS (SELECT id, arg_min(cell_id, sqrt(dx * dx + dy * dy)) AS behind FROM j WHERE side = 0 AND along < 0 GROUP BY 1),
a AS (SELECT id, arg_min(cell_id, sqrt(dx * dx + dy * dy) + 0.15 * abs((degrees(atan2(dx, -dy)) - bearing + 900) % 360 - 180)) AS ahead FROM j WHERE side = 1 AND along > 0 GROUP BY 1)
SELECT n_nationkey AS id, coalesce(behind, -1) AS behind, coalesce(ahead, -1) AS ahead FROM nation LEFT JOIN b ON b.id = n_nationkey LEFT JOIN a ON a.id = n_nationkey""")
def sites_opposite_pair(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    s = table(spark, sf, "nation").select(k.alias("id"), (k * 2.0).alias("x"), (k * 0.5 + 1.0).alias("y"), (k * 14.5).alias("bearing"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    c = mesh.triangle_geometry(*V.mesh(spark, sf)).withColumn("component", F.col("cell_id") % 2)
    r = sites.opposite_side_pair(s, c)
    return r.select("id", F.coalesce("behind", F.lit(-1)).alias("behind"), F.coalesce("ahead", F.lit(-1)).alias("ahead"))


_PLACES = {k: (33.852 + i * 0.006, 130.66 + i * 0.007) for i, k in enumerate(flow.PLACES)}
_LL = "33.85 + id % 500 / 10000.0 AS lat, 130.65 + id % 700 / 10000.0 AS lng"


def _metres(a: float, b: float) -> str:
    return f"sqrt(((lng - {b}) * 111320.0 * cos(radians((lat + {a}) * 0.5))) ** 2 + ((lat - {a}) * 111320.0) ** 2)"


@query(f"""WITH {V.POINTS}, p AS (SELECT id, id % 10 / 10.0 AS rain, id % 7 / 10.0 - 0.3 AS slope, id % 2 = 0 AS night, id % 3 = 0 AS winter, {_LL} FROM points),
d AS (SELECT *, least(1, greatest(0, rain * 0.85 + greatest(0, -slope) * 0.25 - 0.08)) AS opening, {", ".join(f"{_metres(*at)} AS {k}" for k, at in _PLACES.items())} FROM p),
s AS (SELECT *, CASE WHEN opening <= 0.001 THEN 0 ELSE least(1, greatest(0, exp(-(barrage ** 2) / 31250) * opening * 0.125)) END AS s1,
 least(0.42, greatest(0.08, 0.15 + rain * 0.14 + CASE WHEN slope > 0 THEN 0.08 ELSE 0.03 END - opening * 0.05)) * (0.72 * exp(-(fishway ** 2) / 15488) + 0.28 / (1 + fishway / 180)) AS s2,
 (0.18 + rain * 0.55) * (0.65 / (1 + mouth_a / 320) + 0.35 / (1 + confluence / 360)) AS s3, (0.16 + rain * 0.5) * (0.65 / (1 + mouth_b / 300) + 0.35 / (1 + confluence / 360)) AS s4,
 (0.16 + abs(slope) * 0.95) * (0.65 / (1 + sea / 470) + 0.35 / (1 + confluence / 520)) AS s5 FROM d),
t AS (SELECT *, s1 + s2 + s3 + s4 + s5 AS total, greatest(s1, s2, s3, s4, s5) / (s1 + s2 + s3 + s4 + s5 + 0.0001) AS top FROM s)
SELECT id, round(least(100, greatest(0, 18 + least(1, total) * 30 + (1 - top) * least(1, total) * 22 + (s3 + s4) * 16 / (1 + confluence / 250) + s2 * 18 + s1 * 14 + s5 * 7 + rain * 6 + 6 / (1 + sea / 300) + 4 / (1 + port / 250)
 + CASE WHEN night THEN 8 ELSE 0 END + CASE WHEN night AND winter AND slope > 0 AND opening < 0.05 THEN 14 ELSE 0 END - CASE WHEN opening <= 0.001 THEN 8 / (1 + barrage / 180) ELSE 0 END - CASE WHEN abs(slope) < 0.015 THEN 5 ELSE 0 END)), 5) + 0.0 AS score,
 round(top, 5) + 0.0 AS share, CASE greatest(s1, s2, s3, s4, s5) WHEN s1 THEN 'gate' WHEN s2 THEN 'fishway' WHEN s3 THEN 'tributary_a' WHEN s4 THEN 'tributary_b' ELSE 'tide' END AS dominant FROM t""")
def flow_site_scores(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id")
    p = V.points(spark, sf).select("id", (k % 10 / 10.0).alias("rain"), (k % 7 / 10.0 - 0.3).alias("slope"), (k % 2 == 0).alias("night"), (k % 3 == 0).alias("winter"), (33.85 + k % 500 / 10000.0).alias("lat"), (130.65 + k % 700 / 10000.0).alias("lng"))
    rain, slope, lat, lng = (F.col(c) for c in ("rain", "slope", "lat", "lng"))
    d, opening = flow.place_distances(lat, lng, _PLACES), flow.automatic_opening(rain, slope)
    gates = F.array(F.struct(F.lit(_PLACES["barrage"][0]).alias("lat"), F.lit(_PLACES["barrage"][1]).alias("lng")))
    raw = flow.flow_sources(d, flow.gate_kernel(lat, lng, gates, opening, 1 / 8), rain, slope, opening)
    ranked = flow.ranked_labels(flow.shares(raw))
    score = flow.site_score(raw, d, rain, slope, opening, F.col("night"), F.col("winter"))
    return rounded(p.select("id", score.alias("score"), F.get(ranked, F.lit(0))["value"].alias("share"), F.get(ranked, F.lit(0))["label"].alias("dominant")), 5)


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_discount * 5 AS f, l_tax * 10 AS a, l_quantity / 60 AS b, l_discount + l_tax AS c FROM lineitem), t AS (SELECT *, greatest(0.001, f + a + b + c) AS t FROM r), s AS (SELECT l_orderkey, l_linenumber, f / t AS f, a / t AS a, b / t AS b, c / t AS c FROM t),
m AS (SELECT *, 1 - greatest(f, a, b, c) AS rest, least(1, greatest(0, (1 - greatest(f, a, b, c)) * 1.35 + least(c, f + a + b) * 0.3)) AS front FROM s)
SELECT l_orderkey, l_linenumber, round(f, 6) + 0.0 AS fishway, round(front, 6) + 0.0 AS front, round(rest, 6) + 0.0 AS mixing, round(least(1, greatest(0, least(f + c, a + b) * 1.2 + front * 0.2)), 6) + 0.0 AS branch_mix, round(least(1, greatest(0, 0.5 - least(0.085, b * 0.05 + a * 0.04) + least(0.025, f * 0.025))), 6) + 0.0 AS score FROM m""")
def flow_closed_mix(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    mix = flow.closed_mix(F.col("l_discount") * 5, F.col("l_tax") * 10, F.col("l_quantity") / 60, F.col("l_discount") + F.col("l_tax"))
    score = flow.closed_score(F.lit(0.5), mix["tributary_b"], mix["tributary_a"], mix["fishway"])
    return rounded(li.select("l_orderkey", "l_linenumber", *[mix[k].alias(k) for k in ("fishway", "front", "mixing", "branch_mix")], score.alias("score")))


_SLOPE = "(sin(2 * pi() * ({0} + 1) / 12.42) - sin(2 * pi() * ({0} - 1) / 12.42)) / 2"


@query(f"""WITH {V.SERIES}, e AS (SELECT ordinal, t / 3600 - 473000 AS h, t / 3600 % 24 AS hour, flag = 'error' AS closed FROM series), s AS (SELECT *, {_SLOPE.format("h")} AS s, abs({_SLOPE.format("(h - 1.5)")}) AS before, abs({_SLOPE.format("(h + 1.5)")}) AS after, CASE WHEN hour >= 18 OR hour <= 5 THEN 1 WHEN hour >= 16.5 THEN 0.45 WHEN hour <= 7 THEN 0.35 ELSE 0 END::DOUBLE AS night FROM e),
w AS (SELECT *, least(1, abs(s) * 2.35) AS move, abs(s) > 0.025 AND (before < 0.03 OR after < 0.03) AS turn FROM s),
c AS (SELECT *, least(100, greatest(0, 34 + move * 18 + night * 16 + CASE WHEN turn THEN 10 ELSE 0 END + least(1, 0.25 + move * 0.75) * 10 + CASE WHEN closed THEN 17.98 ELSE 7.52 END - CASE WHEN abs(s) < 0.015 THEN 16 ELSE 0 END - CASE WHEN night < 0.2 THEN 6 ELSE 0 END + CASE WHEN s < 0 AND night > 0.4 THEN 5 ELSE 0 END + CASE WHEN s > 0 AND closed THEN 3 ELSE 0 END)) AS score FROM w)
SELECT ordinal, round(score, 5) + 0.0 AS score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade, turn, night FROM c""")
def series_window_score(spark: SparkSession, sf: str) -> DataFrame:
    h, hour, closed = F.col("t") / 3600 - 473_000, F.col("t") / 3600 % 24, F.col("flag") == "error"
    score = scalar.window_score(h, hour, closed)
    return rounded(V.series(spark, sf).select("ordinal", score.alias("score"), scalar.grade(score).alias("grade"), scalar.near_turn(h).alias("turn"), scalar.night_score(hour).alias("night")), 5)


def _occupied(spark: SparkSession, sf: str, least: float, scene: str | None = None) -> DataFrame:
    wanted = F.lit(True) if scene is None else F.col("scene") == scene
    return V.points(spark, sf).where((F.col("score") > least) & wanted).select(F.floor(F.col("x") / 18).alias("ix"), F.floor(F.col("y") / 18).alias("iy")).distinct()


@query()
def raster_component_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = _occupied(spark, sf, 0.5)
    return raster.component_filter(c, V.points(spark, sf), 18.0, F.col("ix") > 54, c.where("ix = iy"))


_GRID = "SELECT floor(x / 18)::BIGINT AS ix, floor(y / 18)::BIGINT AS iy, max(score) > {0} AS water, max(score) AS depth FROM points WHERE scene = '{1}' GROUP BY 1, 2"


@query(f"""WITH {V.POINTS}, b AS ({_GRID.format(0.6, "click")}), a AS ({_GRID.format(0.5, "view")}), j AS (SELECT ix, iy, coalesce(b.water, false) AS was, coalesce(a.water, false) AS water, b.depth AS bd, a.depth AS ad FROM b FULL JOIN a USING (ix, iy))
SELECT ix, iy, water, CASE WHEN water AND NOT was THEN 'added' WHEN was AND NOT water THEN 'removed' ELSE '-' END AS change, round(CASE WHEN NOT water THEN 0 WHEN was THEN bd ELSE ad END, 6) + 0.0 AS depth FROM j""")
def raster_grid_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    grid = lambda least, scene: V.points(spark, sf).where(F.col("scene") == scene).groupBy(F.floor(F.col("x") / 18).alias("ix"), F.floor(F.col("y") / 18).alias("iy")).agg((F.max("score") > least).alias("water"), F.max("score").alias("depth"))
    return rounded(raster.grid_reconcile(grid(0.6, "click"), grid(0.5, "view"), ["depth"]).withColumn("change", F.coalesce("change", F.lit("-"))))


@query(f"""WITH {V.POINTS}, a AS (SELECT DISTINCT floor(x / 18) AS ix, floor(y / 18) AS iy FROM points WHERE score > 0.5 AND scene = 'click'), b AS (SELECT DISTINCT floor(x / 18) AS ix, floor(y / 18) AS iy FROM points WHERE score > 0.6 AND scene = 'view')
SELECT count(*) FILTER (a.ix IS NULL OR b.ix IS NULL) AS different, count(*) FILTER (b.ix IS NULL) AS false_negative, count(*) FILTER (a.ix IS NULL) AS false_positive FROM a FULL JOIN b ON a.ix = b.ix AND a.iy = b.iy""")
def raster_grid_confusion(spark: SparkSession, sf: str) -> DataFrame:
    flagged = lambda least, scene: _occupied(spark, sf, least, scene).withColumn("flag", F.lit(True))
    return raster.grid_confusion(flagged(0.5, "click"), flagged(0.6, "view"))


_LINE = (-0.5, 4.01, 33.3, 20.2)


@query(f"""WITH {V.MESH}, {_CORNERS}, c AS (SELECT cell_id, (ax + bx + cx) / 3 AS x, (ay + by_ + cy) / 3 AS y FROM corners), f AS (SELECT lo * 1000000 + hi AS face_id, l.x AS lx, l.y AS ly, r.x AS rx, r.y AS ry, (p.x + q.x) / 2 AS mx, (p.y + q.y) / 2 AS my FROM edge JOIN vert p ON p.vertex_id = lo JOIN vert q ON q.vertex_id = hi JOIN c l ON l.cell_id = "left" LEFT JOIN c r ON r.cell_id = "right"),
s AS (SELECT *, {_LINE[2] - _LINE[0]} * (ly - {_LINE[1]}) - {_LINE[3] - _LINE[1]} * (lx - {_LINE[0]}) AS a, {_LINE[2] - _LINE[0]} * (ry - {_LINE[1]}) - {_LINE[3] - _LINE[1]} * (rx - {_LINE[0]}) AS b FROM f),
x AS (SELECT *, lx + a / (a - b) * (rx - lx) AS x, ly + a / (a - b) * (ry - ly) AS y FROM s), k AS (SELECT *, ((x - {_LINE[0]}) * {_LINE[2] - _LINE[0]} + (y - {_LINE[1]}) * {_LINE[3] - _LINE[1]}) / {(_LINE[2] - _LINE[0]) ** 2 + (_LINE[3] - _LINE[1]) ** 2} AS t, ((mx - {_LINE[0]}) * {_LINE[2] - _LINE[0]} + (my - {_LINE[1]}) * {_LINE[3] - _LINE[1]}) / {(_LINE[2] - _LINE[0]) ** 2 + (_LINE[3] - _LINE[1]) ** 2} AS u FROM x)
SELECT face_id, (least(floor(least(1, greatest(0, u)) * 8), 7) + 1)::INT AS gate FROM k WHERE (a * b < 0 AND t BETWEEN 0 AND 1) OR face_id % 97 = 0""")
def mesh_cut_faces(spark: SparkSession, sf: str) -> DataFrame:
    tri, v = V.mesh(spark, sf)
    cells = mesh.triangle_geometry(tri, v)
    c = lambda k, p: cells.select(F.col("cell_id").alias(k), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    g = mesh.face_geometry(mesh.edge_incidence(tri), v, cells).join(c("left", "l"), "left").join(c("right", "r"), "right", "left")
    f = g.select((F.col("lo") * 1_000_000 + F.col("hi")).alias("face_id"), "lx", "ly", "rx", "ry", "mx", "my")
    return mesh.cut_faces(f, _LINE, f.where("face_id % 97 = 0"))


@query(f"""WITH {V.MESH}, {_CORNERS}, z AS (SELECT greatest((hx - lx + 2 * greatest(1e-6, (hx - lx) * 0.025)) / 97, (hy - ly + 2 * greatest(1e-6, (hy - ly) * 0.025)) / 61) AS px, (lx + hx) / 2 AS mx, (ly + hy) / 2 AS my FROM (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM vert)),
p AS (SELECT r::INT AS row, c::INT AS col, mx + (c + 0.5 - 48.5) * px AS x, my - (r + 0.5 - 30.5) * px AS y FROM z, range(61) a(r), range(97) b(c))
SELECT row, col, max(cell_id) AS cell_id FROM p JOIN corners ON x BETWEEN least(ax, bx, cx) - 1e-9 AND greatest(ax, bx, cx) + 1e-9 AND y BETWEEN least(ay, by_, cy) - 1e-9 AND greatest(ay, by_, cy) + 1e-9
WHERE {_W1} >= -1e-12 AND {_W2} >= -1e-12 AND 1 - {_W1} - {_W2} >= -1e-12 GROUP BY 1, 2""")
def mesh_raster(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.rasterised_cells(*V.mesh(spark, sf), 97, 61)


@query("SELECT page_id, html AS text, CASE page_id % 3 WHEN 0 THEN 'utf-16' WHEN 1 THEN 'utf-8' ELSE coalesce(nullif(regexp_extract(html[:4096], '(?i)charset\\s*=\\s*[\"'']?([A-Za-z0-9._-]+)', 1), ''), 'utf-8') END AS encoding FROM pages")
def web_decode(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 3
    p = table(spark, sf, "pages").select("page_id", F.when(k == 0, F.encode("html", "UTF-16")).otherwise(F.encode("html", "UTF-8")).alias("body"), F.when(k == 0, "text/html; charset=utf-16").when(k == 1, "text/html; Charset=utf-8").alias("kind"))
    return web.decoded(p, "body", "kind").select("page_id", "text", "encoding")


@query("""SELECT page_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(html, '(?i)https?://[^"''\\s)]+', 0), lambda x: trim(x)), lambda x: length(x) BETWEEN 3 AND 600))) AS n FROM pages""")
def web_candidate_strings(spark: SparkSession, sf: str) -> DataFrame:
    found = web.candidate_strings(F.col("html"), 1 << 30)
    return table(spark, sf, "pages").select("page_id", F.size(F.filter(found, lambda s: F.lower(s).rlike("^https?://"))).cast("long").alias("n"))


@query("""SELECT event_id, '{"a":{"k":' || json_extract_string(props, '$.k') || ',"n":' || user_id || '},"b":[' || event_id || ',null],"z":"' || event_type || '"}' AS text FROM events""")
def json_canonical(spark: SparkSession, sf: str) -> DataFrame:
    text = F.format_string('{"z": "%s", "b": [%d, null], "a": {"n": %d, "k": %s}}', "event_type", "event_id", "user_id", F.get_json_object("props", "$.k"))
    return table(spark, sf, "events").select("event_id", scalar.canonical_json(text).alias("text"))


@query(f"""WITH {V.SERIES}, r AS (SELECT ordinal, value, value / greatest(value, 5) * 3 AS u, -value / greatest(value, 5) * 2 AS v FROM series), s AS (SELECT *, sqrt(u * u + v * v) AS s FROM r)
SELECT ordinal, round(CASE WHEN value < 20 THEN 0 WHEN s > 2 THEN u * 2 / s ELSE u END, 6) + 0.0 AS u, round(CASE WHEN value < 20 THEN 0 WHEN s > 2 THEN v * 2 / s ELSE v END, 6) + 0.0 AS v FROM s""")
def series_regularised(spark: SparkSession, sf: str) -> DataFrame:
    s = V.series(spark, sf).select("ordinal", F.col("value").alias("h"), (F.col("value") * 3).alias("hu"), (F.col("value") * -2).alias("hv"), F.lit(1.0).alias("area"), (F.col("value") >= 20).cast("int").alias("wet"))
    return rounded(series.regularised(s, 5.0, 2.0).select("ordinal", "u", "v"))


@query("""WITH l AS (SELECT o_custkey AS "group", o_totalprice AS h, o_totalprice % 1000 AS error FROM orders), p AS (SELECT *, lead(h) OVER w AS h2, lead(error) OVER w AS e2 FROM l WINDOW w AS (PARTITION BY "group" ORDER BY h DESC))
SELECT "group", count(*) AS n, round(avg(ln(error / e2) / ln(h / h2)), 4) + 0.0 AS mean FROM p WHERE h > h2 AND h2 > 0 AND error > 0 AND e2 > 0 GROUP BY 1""")
def series_convergence(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("group"), F.col("o_totalprice").alias("h"), (F.col("o_totalprice") % 1000).alias("error"))
    r = series.convergence_orders(o).where("`order` is not null")
    return rounded(r.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("order").alias("mean")), 4)


@query(f"""WITH {V.POINTS}, s AS (SELECT id, greatest(1, ceil(sqrt((score * 50) ** 2 + 400) / 7))::INT AS n, x AS ax, y AS ay, x + score * 50 AS bx, y + 20 AS by_ FROM points), k AS (SELECT *, unnest(generate_series(0, n))::INT AS k FROM s)
SELECT id AS segment_id, k, round(ax + (bx - ax) * (k / n::DOUBLE), 5) + 0.0 AS x, round(ay + (by_ - ay) * (k / n::DOUBLE), 5) + 0.0 AS y FROM k""")
def raster_densified(spark: SparkSession, sf: str) -> DataFrame:
    s = V.points(spark, sf).select(F.col("id").alias("segment_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + F.col("score") * 50).alias("bx"), (F.col("y") + 20).alias("by"))
    return rounded(raster.densified(s, 7.0), 5)


@query("""SELECT l_orderkey * 8 + l_linenumber AS edge_id, CASE WHEN (l_orderkey * 8 + l_linenumber) % 3 > 0 AND (l_orderkey * 8 + l_linenumber) % 10 < 8 THEN (l_orderkey * 8 + l_linenumber) % 10 / 8.0 ELSE 1 END::DOUBLE AS multiplier FROM lineitem""")
def graph_edge_multipliers(spark: SparkSession, sf: str) -> DataFrame:
    e = V.edges(spark, sf)
    gates = e.where("edge_id % 3 > 0").select("edge_id", (F.col("edge_id") % 10).cast("int").alias("gate")).distinct()
    openings = spark.createDataFrame([(k, k / 8) for k in range(8)], "gate int, opening double")
    return graph.edge_multipliers(e, gates, openings).select("edge_id", "multiplier")


@query(f"""WITH {V.MESH} SELECT count(*) FILTER (lo % 50 > 0) + count(*) FILTER (lo % 50 > 0 AND lo % 11 = 3) AS matched, 0::BIGINT AS extra, count(*) FILTER (lo % 50 = 0) AS missing, count(*) FILTER (lo % 50 > 0 AND lo % 11 = 3) AS duplicate, count(*) FILTER (lo % 50 > 0 AND lo % 7 = 0) + count(*) FILTER (lo % 50 > 0 AND lo % 77 = 14) AS cell_mismatch, count(*) FILTER (lo % 50 > 0 AND lo % 13 = 0) + count(*) FILTER (lo % 50 > 0 AND lo % 13 = 0 AND lo % 11 = 3) AS marker_mismatch, 0.0::DOUBLE AS length_error, 0.0::DOUBLE AS centre_error, 0.0::DOUBLE AS midpoint_error FROM edge""")
def mesh_compare_faces(spark: SparkSession, sf: str) -> DataFrame:
    tri, v = V.mesh(spark, sf)
    f = mesh.face_geometry(mesh.edge_incidence(tri), v, mesh.triangle_geometry(tri, v)).withColumnsRenamed({"lo": "a", "hi": "b"}).withColumn("marker", F.col("a") % 3)
    exported = f.where("a % 50 > 0").withColumn("left", F.when(F.col("a") % 7 == 0, F.col("left") + 1_000_000_000).otherwise(F.col("left"))).withColumn("marker", F.when(F.col("a") % 13 == 0, 9).otherwise(F.col("marker")))
    return rounded(mesh.compare_faces(exported.union(exported.where("a % 11 = 3")), f))


@query("""WITH c AS (SELECT l_suppkey AS g, cos(2 * pi() * l_quantity / 50) AS c, l_extendedprice AS v, l_discount + 0.01 AS w FROM lineitem), s AS (SELECT g, sum(w) AS w, sum(w * c) AS c, sum(w * c * c) AS cc, sum(w * v) AS v, sum(w * v * c) AS vc, count(*) AS n FROM c GROUP BY 1)
SELECT g AS "group", round((w * vc - c * v) / (w * cc - c * c), 4) + 0.0 AS amplitude, round(v / w, 4) + 0.0 AS mean FROM s""")
def quality_mode_projection(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("group"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("value"), (F.col("l_discount") + 0.01).alias("weight"))
    return rounded(quality.mode_projection(p, 2, 50.0), 4)


@query("""SELECT l_suppkey AS "group", count(*) FILTER (l_discount <= 0.08) AS passed, count(*) AS total, CASE WHEN count(*) FILTER (l_discount <= 0.08) = count(*) THEN 'passed' ELSE 'failed' END AS status FROM lineitem GROUP BY 1""")
def quality_assessed(spark: SparkSession, sf: str) -> DataFrame:
    return quality.assessed(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("group"), (F.col("l_discount") <= 0.08).alias("ok")), "group")


@query(f"""WITH {V.POINTS}, p AS (SELECT id, {_LL} FROM points), b(k, la, ln) AS (VALUES (1, 33.86, 130.66), (2, 33.87, 130.69), (3, 33.89, 130.71)), d AS (SELECT id, k, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(la - lat) / 2), 2) + cos(radians(lat)) * cos(radians(la)) * pow(sin(radians(ln - lng) / 2), 2))) AS d FROM p, b)
SELECT id, arg_min(k, d) AS nearest, round(min(d), 3) + 0.0 AS d FROM d GROUP BY 1""")
def spatial_nearest_boundary(spark: SparkSession, sf: str) -> DataFrame:
    p = V.points(spark, sf).select("id", (33.85 + F.col("id") % 500 / 10000.0).alias("lat"), (130.65 + F.col("id") % 700 / 10000.0).alias("lng"))
    b = spark.createDataFrame([(1, 33.86, 130.66), (2, 33.87, 130.69), (3, 33.89, 130.71)], "id int, lat double, lng double")
    return rounded(spatial.nearest_boundary(p, b), 3)


_CUSTOMERS = "SELECT c_custkey AS id, c_custkey * 37 % 1301 / 10.0 - 60 AS lat, c_custkey * 91 % 3593 / 10.0 - 179.5 AS lng FROM customer"


@query(f"""WITH b AS ({_CUSTOMERS}), p AS (SELECT o_orderkey AS id, o_orderkey * 53 % 1499 / 10.0 - 75 AS lat, o_orderkey * 29 % 3583 / 10.0 - 179.5 AS lng FROM orders),
d AS (SELECT p.id, b.id AS k, 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(b.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - p.lng) / 2), 2)))) AS d FROM p, b)
SELECT id, round(min(d), 3) + 0.0 AS d FROM d GROUP BY 1""")
def spatial_nearest_of_many(spark: SparkSession, sf: str) -> DataFrame:
    """The distance of each of many points on the globe to the nearest of many others."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    b = table(spark, sf, "customer").select(c.alias("id"), (c * 37 % 1301 / 10.0 - 60).alias("lat"), (c * 91 % 3593 / 10.0 - 179.5).alias("lng"))
    p = table(spark, sf, "orders").select(o.alias("id"), (o * 53 % 1499 / 10.0 - 75).alias("lat"), (o * 29 % 3583 / 10.0 - 179.5).alias("lng"))
    return rounded(spatial.nearest_boundary(p, b).select("id", "d"), 3)


@query(f"WITH {V.RUNS} SELECT row, l_ix AS run_ix, x0, x1 FROM (SELECT row, x0, x1, (row_number() OVER (PARTITION BY row ORDER BY x0, x1) - 1)::INT AS l_ix FROM runs)")
def source_raster_rows(spark: SparkSession, sf: str) -> DataFrame:
    ends = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1"))), lambda r: F.array(r["x0"], r["x1"])))
    chunks = V.runs(spark, sf).groupBy("row").agg(ends.alias("ends")).select(F.col("row").alias("startRow"), F.array("ends").alias("rows"))
    return tables.raster_rows(chunks)


@query(f"WITH {V.MESH} SELECT cell_id, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c FROM tri")
def source_mesh_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = tables.mesh_chunks(V.mesh(spark, sf)[0].select("cell_id", "a", "b", "c"), "triangle", "cell_id", 100)
    return tables.mesh_rows(chunks, "triangle", ["a", "b", "c"]).withColumnRenamed("index", "cell_id")


@query("SELECT user_id AS station, event_id::VARCHAR AS obs_time, value AS level, event_type AS flag FROM events")
def source_station_series(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    reading = F.to_json(F.struct(F.array(F.struct(F.col("event_id").cast("string").alias("obsTime"), F.col("value").alias("stg"), F.col("event_type").alias("stgCcd"))).alias("hrValues")))
    return tables.station_series(e.select(F.col("user_id").alias("station"), reading.alias("payload")))


@query("""WITH w AS (SELECT user_id AS series_id, ts, value, unnest([0, 1, 2]) AS k FROM events), b AS (SELECT series_id, value, to_timestamp((floor(epoch_us(ts) / 1800e6) - k) * 1800) AT TIME ZONE 'UTC' AS w FROM w)
SELECT series_id, epoch_us(w) // 1000000 AS begin, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, min(value) AS low, max(value) AS high FROM b GROUP BY 1, w""")
def stream_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").select(F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return rounded(stateful.stream_summary(s).withColumn("begin", F.unix_seconds("begin")))


@query(f"""WITH {V.CASES} SELECT case_id, code, path FROM (SELECT *, unnest([CASE WHEN case_id % 50 = 0 THEN 'steps' END, CASE WHEN NOT (cfl BETWEEN 0 AND 0.95) THEN 'cfl' END, CASE WHEN abs(mass_error) > 4.5e-9 THEN 'mass' END, CASE WHEN min_depth < 0 THEN 'depth' END]) AS code,
 unnest(['$.steps', '$.max_cfl', '$.mass_error', '$.min_depth']) AS path FROM cases) WHERE code IS NOT NULL""")
def quality_threshold_rules(spark: SparkSession, sf: str) -> DataFrame:
    c = V.cases(spark, sf).withColumnRenamed("cfl", "max_cfl").withColumn("steps", F.when(F.col("case_id") % 50 == 0, 499).otherwise(500))
    c = c.withColumns({"nan_count": F.lit(0), "negative_depths": F.lit(0), "simulated_s": F.lit(1.0), "min_step_s": F.lit(0.1), "max_step_s": F.lit(0.2)})
    return quality.blockers(c, "case_id", quality.threshold_rules(500, mass=4.5e-9))


@query("""SELECT s_suppkey AS code, s_nationkey % 3 > 0 AS name_ok, s_suppkey % 2 = 0 AS river_ok, s_nationkey % 3 > 0 AND s_suppkey % 2 = 0 AS ok FROM supplier""")
def quality_station_identity(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("river"), "s_nationkey")
    expected = s.withColumn("name", F.when(F.col("s_nationkey") % 3 == 0, "other").otherwise(F.col("name"))).withColumn("river", F.when(F.col("code") % 2 == 1, "other").otherwise(F.col("river")))
    return quality.station_identity(s, expected)


@query("""SELECT count(*) * len(any_value(embedding)) AS n, count(*) AS cases, 0::BIGINT AS not_finite, sum(len(list_filter(embedding, lambda x: x < 0)))::BIGINT AS negative_depth, 0::BIGINT AS uneven FROM embeddings""")
def source_field_problems(spark: SparkSession, sf: str) -> DataFrame:
    return tables.field_problems(V.field(spark, sf).withColumn("depth", F.col("u")))


@query(f"""WITH {V.MESH} SELECT cell_id AS ix, 'cell' AS kind, 'Polygon' AS geom_type, 4::BIGINT AS n FROM tri""")
def source_geojson(spark: SparkSession, sf: str) -> DataFrame:
    tri, v = V.mesh(spark, sf)
    t = mesh.with_corners(tri, v).select(F.col("cell_id").alias("ix"), F.lit("cell").alias("kind"), F.lit("Polygon").alias("geom_type"), F.lit(0).alias("ring"), F.posexplode(F.array(*[F.struct(F.col(f"{c}x").alias("lng"), F.col(f"{c}y").alias("lat")) for c in "abc"])).alias("k", "p"))
    f = tables.geojson_features(t.select("ix", "kind", "geom_type", "ring", "k", "p.lng", "p.lat"))
    one = tables.FEATURES.removeprefix("features array<").removesuffix(">")
    r = f.select("ix", F.from_json("feature", one).alias("f")).select("ix", F.col("f.properties")["kind"].alias("kind"), F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"))
    return tables.rings(r).groupBy("ix").agg(F.count(F.lit(1)).alias("n")).join(r.select("ix", "kind", "geom_type"), "ix").select("ix", "kind", "geom_type", "n")
