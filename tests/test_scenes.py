"""Sites, flows, grids and bytes on small fixtures with known answers."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshtide.functions import flow, scalar
from meshtide.operators import mesh, quality, raster, sites, spatial, web
from meshtide.sources import tables

CONTROL = "tri int, ax double, ay double, bx double, by double, cx double, cy double, ux double, uy double, vx double, vy double, wx double, wy double"


def got(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def square(feature, x0, y0, x1, y1):
    c = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return [(feature, 0, *map(float, a), *map(float, b)) for a, b in zip(c, c[1:] + c[:1])]


EDGES = "feature int, ring int, ax double, ay double, bx double, by double"


def test_piecewise_affine(spark):
    control = [(1, 0, 0, 4, 0, 0, 4, 10, 10, 18, 10, 10, 18), (2, 4, 0, 4, 4, 0, 4, 0, 0, 0, 0, 0, 0), (0, 1, 1, 2, 2, 3, 3, 9, 9, 9, 9, 9, 9)]
    points = [(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 50.0, 5.0), (4, None, 1.0)]
    r = got(sites.piecewise_affine(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame([(c[0], *map(float, c[1:])) for c in control], CONTROL), 1.5), "id")
    assert r == [(1, 12.0, 12.0, 1), (2, 14.0, 14.0, 1), (3, 50.0, 5.0, None), (4, None, 1.0, None)]


def test_control_points(spark):
    runs = spark.createDataFrame([(5, 2, 8)], "row int, x0 int, x1 int")
    p = spark.createDataFrame([(1, 3.2, 5.5, 3.2, 5.46, "water"), (2, 1.0, 1.0, 1.0, 1.0, "land"), (3, 4.0, 5.0, 4.0, 5.0, None)], "id int, x double, y double, px double, py double, semantic string")
    n, error, wrong, ok = sites.control_point_check(p, runs).first()
    assert (n, wrong, ok) == (3, 1, False) and abs(error - 0.04) < 1e-9
    assert sites.control_point_check(p.where("id < 3"), runs).first()["ok"]
    assert not sites.control_point_check(p.where("id > 9"), runs).first()["ok"]


def test_land_water(spark):
    e = spark.createDataFrame(square(0, 0, 0, 10, 10) + square(1, 4, 4, 6, 6), EDGES)
    boxes = spark.createDataFrame([(12.0, 0.0, 14.0, 10.0)], "x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame([(1, 5.0, 5.0, True), (2, 2.0, 2.0, False), (3, 14.4, 5.0, True), (4, 30.0, 5.0, True), (5, 30.0, 5.0, None)], "id int, x double, y double, fallback boolean")
    assert got(sites.land_water(p, e.where("feature = 1"), e.where("feature = 0"), boxes, 3.0, 0.5), "id") == [(1, False), (2, True), (3, False), (4, True), (5, None)]


def test_tagged_faces(spark):
    f = spark.createDataFrame([(k, float(k), 0.0) for k in range(10)] + [(20, 3.0, 9.0)], "face_id int, mx double, my double")
    o = spark.createDataFrame([("N", 2.0, 4.0, "top"), ("S", 3.0, 3.0, "bottom"), ("M", 4.2, 6.0, "top")], "tag string, x0 double, x1 double, side string")
    assert got(sites.tagged_faces(f, o, 2.0), "face_id") == [(2, "N", False), (3, "N", False), (4, "M", True), (5, "M", False), (6, "M", False), (20, "S", False)]


def test_grid_samples(spark):
    r = spark.createDataFrame([(1, 0.0, 0.0, 0.01, 0.01)], "region int, south double, west double, north double, east double")
    e = spark.createDataFrame(square(1, 0.002, 0.002, 0.008, 0.008) + square(2, -1, -1, 1, 1), EDGES)
    s = got(sites.grid_samples(r, e, 111.32, 0.001), "row", "col")
    assert len(s) == 36 and {x[0] for x in s} == {1} and all(0.002 <= x[3] <= 0.0081 and 0.002 <= x[4] <= 0.0081 for x in s)


def test_tiers_and_weights(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 500.0, 0.0, 1.0), (3, 900.0, 0.0, 1.0)], "id int, x double, y double, score double")
    first = spark.createDataFrame([(10, 34.0, 0.0), (11, 3.0, 0.0)], "id int, x double, y double")
    second = spark.createDataFrame([(12, 1.0, 34.0), (13, 500.0, 35.0)], "id int, x double, y double")
    r = got(sites.tiered_stands(t, [(first, sites.near_stand_weight, 1.0), (second, sites.wide_stand_weight, 0.92)]).select("target", "stand", "tier", F.round("score", 6)), "target")
    assert r == [(1, 10, 0, 1.0), (2, 13, 1, 0.92)]
    w = spark.range(1).select(sites.near_stand_weight(F.lit(4.0))).first()[0]
    assert abs(w - 0.55 * (0.66 + 0.34 * math.exp(-0.5))) < 1e-12


@pytest.mark.parametrize("most", [10_000, 1])
def test_nearest_axis_normalized(spark, most):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 100.0, 0.0), (2, 0, 0.0, 40.0), (2, 1, 100.0, 40.0)], "line_id int, ix int, x double, y double")
    p = spark.createDataFrame([(1, 50.0, 15.0), (2, 25.0, 30.0)], "id int, x double, y double")
    width = F.when(F.col("line_id") == 1, 10.0).otherwise(100.0)
    r = got(sites.nearest_axis_normalized(p, spatial.polyline_measure(v), width, most=most), "id")
    assert [(x[1], round(x[3], 9), round(x[4], 9), round(x[5], 9)) for x in r] == [(2, 25.0, -25.0, 0.5), (2, 10.0, -10.0, 0.25)]
    assert abs(r[0][8] - 25 / (140 * 0.55)) < 1e-12


def test_cast_ring(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 0.0)], "id int, x double, y double")
    water = spark.createDataFrame(square(0, 20, -50, 200, 50) + square(1, 4000, -1000, 6000, 1000), EDGES)
    (r,) = got(sites.cast_candidate_ring(t, water, 25.0), "id")
    assert r[0] == 1 and r[3:] == (72.0, 2.0) and abs(math.hypot(r[1], r[2]) - 72) < 1e-9 and r[2] > 50
    (far,) = got(sites.cast_candidate_ring(t.where("id = 1"), water, 25.0, (r[1], r[2])), "id")
    assert math.hypot(far[1] - r[1], far[2] - r[2]) >= 90 and far[4] == 2.0


def test_opposite_pair(spark):
    c = spark.createDataFrame([(1, 0.0, 5.0, 7), (2, 0.0, 9.0, 7), (3, 0.0, -6.0, 8), (4, 1.0, -5.5, 8), (5, 0.0, -1.0, 7)], "cell_id int, x double, y double, component int")
    s = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 7, 8), (2, 0.0, 0.0, 0.0, 9, 9)], "id int, x double, y double, bearing double, up int, down int")
    assert got(sites.opposite_side_pair(s, c), "id") == [(1, 1, 3), (2, None, None)]


def test_component_filter(spark):
    rng = random.Random(5)
    cells = {(rng.randrange(14), rng.randrange(14)) for _ in range(110)}
    points = [(x + rng.random(), y + rng.random(), rng.random()) for x, y in cells for _ in range(rng.randrange(3))]
    label = {}
    for start in sorted(cells):
        if start in label:
            continue
        todo, label[start] = [start], start
        while todo:
            x, y = todo.pop()
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in cells and n not in label:
                    label[n] = start
                    todo.append(n)
    size = {s: sum(v == s for v in label.values()) for s in set(label.values())}
    held = {s: sum(label.get((int(x), int(y))) == s for x, y, _ in points) for s in size}
    largest = max(size.values())
    want = {c for c in cells if any(label[h] == label[c] for h in cells if h[0] == h[1]) or any(label[h] == label[c] for h in cells if h[0] > 12) or size[label[c]] >= max(6, 0.3 * largest) or held[label[c]] >= max(9, 0.1 * len(points))}
    c = spark.createDataFrame(sorted(cells), "ix long, iy long")
    p = spark.createDataFrame(points, "x double, y double, score double")
    f = raster.component_filter(c, p, 1.0, F.col("ix") > 12, c.where("ix = iy"), 6, 0.3, 9, 0.1)
    assert {tuple(r) for r in raster.kept_cells(c, f).collect()} == want and 0 < len(want) < len(cells)
    assert sorted((r["cells"], r["points"]) for r in f.collect()) == sorted((size[s], held[s]) for s in size)
    assert raster.component_filter(c.where("ix < 0"), p, 1.0).count() == 0


def test_grid_reconcile(spark):
    t = "ix int, iy int, water boolean, depth double"
    base = spark.createDataFrame([(0, 0, True, 2.0), (1, 0, True, 3.0), (2, 0, False, 0.0), (3, 0, None, None)], t)
    true = spark.createDataFrame([(0, 0, True, 9.0), (2, 0, True, 5.0), (3, 0, True, None), (4, 0, True, 1.0)], t)
    r = raster.grid_reconcile(base, true, ["depth"])
    assert got(r, "ix") == [(0, 0, True, None, 2.0), (1, 0, False, "removed", 0.0), (2, 0, True, "added", 5.0), (3, 0, True, "added", 0.0), (4, 0, True, "added", 1.0)]
    assert tuple(raster.reconcile_counts(r).first()) == (4, 3, 1, 4)


def test_cut_faces_and_raster(spark):
    f = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2.0, 0.0, 1.0), (2, 9.0, 0.0, 9.0, 2.0, 9.0, 1.0), (3, 0.0, 0.0, 1.0, 0.5, 0.5, 0.3), (4, 2.0, 0.0, None, None, 2.0, 0.0), (5, 1.0, 1.0, 1.0, 2.0, 1.0, 1.5)], "face_id int, lx double, ly double, rx double, ry double, mx double, my double")
    marked = spark.createDataFrame([(4,), (4,)], "face_id int")
    assert got(mesh.cut_faces(f, (-1.0, 1.0, 3.0, 1.0), marked), "face_id") == [(1, 3), (4, 7)]
    v = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 2.0, 2.0), (3, 0.0, 2.0)], "vertex_id int, x double, y double")
    tri = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 2, 3), (2, 0, 0, 1)], "cell_id int, a int, b int, c int")
    g = mesh.rasterised_cells(tri, v, 8, 8)
    grid = {(r, c): k for r, c, k in got(g, "row", "col")}
    assert len(grid) == 64 and grid[7, 0] == grid[0, 0] == grid[0, 7] == 1 and grid[7, 7] == 0
    assert tuple(mesh.raster_coverage(g, tri).first())[:2] == (3, 2) and got(mesh.omitted_cells(g, tri), "cell_id") == [(2,)]


def test_bytes_and_json(spark):
    bodies = [(1, "水位".encode("cp932"), "text/html; charset=Shift_JIS"), (2, b"<meta charset='euc_jp'>" + "水".encode("euc_jp"), None), (3, "é水".encode(), "charset=nonsense"), (4, b"\x81", None), (5, None, "x"), (6, b"", None)]
    r = got(web.decoded(spark.createDataFrame(bodies, "id int, body binary, kind string"), "body", "kind").select("id", "text", "encoding"), "id")
    assert r[0][1:] == ("水位", "Shift_JIS") and r[1][1].endswith("水") and r[2][1:] == ("é水", "utf-8")
    assert r[3][2] == "utf-8-replace" and r[4][1:] == (None, None) and r[5][1:] == ("", "utf-8")
    j = spark.createDataFrame([('{"b": [1, {"z": null, "a": true}], "a": "x y"}',), ("no",), (None,)], "t string").select(scalar.canonical_json(F.col("t")))
    assert [x[0] for x in j.collect()] == ['{"a":"x y","b":[1,{"a":true,"z":null}]}', None, None]
    html = spark.createDataFrame([("""see "https://a.b/c?obsCd=1" or '/x/API/level' and "itmkndCd=4" "/x/API/level" """,)], "t string")
    assert html.select(web.candidate_strings(F.col("t"))).first()[0] == ["/x/API/level", "https://a.b/c?obsCd=1", "itmkndCd=4"]


def test_redaction(spark):
    clean = lambda t: spark.range(1).select(scalar.redact(F.lit(t)), scalar.capped_text(F.lit(t))).first()
    assert clean("api_key: 12 AKIA" + "A" * 16 + " ghp_ab1 passed\n ok")[0] == "api_key=[redacted] [redacted] [redacted] success-state ok"
    assert clean("http://a.b/c#frag " + "x" * 40)[0] == "http://a.b/c?[redacted] [redacted]"
    long = clean("ab " * 100)
    assert len(long[0]) == 299 and long[1] == ("ab " * 60)[:179].rstrip() + "…"


def test_flow(spark):
    place = {k: F.lit(0.0) for k in flow.PLACES}
    zero = F.lit(0.0)
    raw = flow.flow_sources(place, F.lit(0.9), zero, zero, zero)
    s = spark.range(1).select(*[v.alias(k) for k, v in raw.items()], flow.site_score(raw, place, zero, zero, zero, F.lit(False), F.lit(False)).alias("score"), flow.automatic_opening(F.lit(1.0), F.lit(-1.0)).alias("open")).first()
    assert [round(s[k], 6) for k in raw] == [0.0, 0.18, 0.18, 0.16, 0.16] and s["open"] == 1.0
    total, top = 0.68, 0.18 / 0.6801
    assert abs(s["score"] - (18 + total * 30 + (1 - top) * total * 22 + 0.34 * 16 + 0.18 * 18 + 0.16 * 7 + 10 - 8 - 5)) < 1e-9
    labels = spark.range(1).select(flow.ranked_labels({"a": F.lit(0.2), "b": F.lit(0.5), "c": F.lit(0.5), "d": F.lit(None)})).first()[0]
    assert [x["label"] for x in labels] == ["b", "c", "a", "d"]
    mix = flow.closed_mix(F.lit(0.6), F.lit(0.2), F.lit(None), F.lit(0.2))
    m = spark.range(1).select(*[v.alias(k) for k, v in mix.items()]).first()
    assert abs(m["fishway"] - 0.6) < 1e-12 and m["label"] == "fishway60% / tributary_a20%" and abs(m["front"] - (0.4 * 1.35 + 0.2 * 0.3)) < 1e-12
    assert spark.range(1).select(flow.closed_score(F.lit(0.5), F.lit(1.0), F.lit(1.0), F.lit(1.0))).first()[0] == pytest.approx(0.44)
    assert spark.range(1).select(flow.closed_text(F.lit("main river"), "main", "side", "shut"), flow.closed_text(F.lit(None), "a", "b", "shut")).first()[:] == ("side river / shut", "shut")
    bait = flow.prey(place, zero, F.lit(0.2), zero, F.lit(True), F.lit(True))
    assert spark.range(1).select(bait).first()[0][0] == ("fry", pytest.approx(0.53))


def test_window_score(spark):
    h = spark.range(0, 97).select((F.col("id") / 4).alias("h"))
    r = h.select("h", scalar.window_score(F.col("h"), F.col("h"), F.lit(True)).alias("s"), scalar.window_reasons(F.col("h"), F.col("h"), F.lit(False), F.lit("gates")).alias("why")).collect()

    def want(t):
        slope = (math.sin(2 * math.pi * (t + 1) / 12.42) - math.sin(2 * math.pi * (t - 1) / 12.42)) / 2
        near = [abs((math.sin(2 * math.pi * (q + 1) / 12.42) - math.sin(2 * math.pi * (q - 1) / 12.42)) / 2) for q in (t - 1.5, t + 1.5)]
        night = 1 if t >= 18 or t <= 5 else 0.45 if t >= 16.5 else 0.35 if t <= 7 else 0
        move = min(1, abs(slope) * 2.35)
        s = 34 + 18 * move + 16 * night + 10 * (abs(slope) > 0.025 and min(near) < 0.03) + 10 * min(1, 0.25 + 0.75 * move) + 0.78 * 8 + 0.82 * 7 + 6
        return min(100, max(0, s - 16 * (abs(slope) < 0.015) - 6 * (night < 0.2) + 5 * (slope < 0 and night > 0.4) + 3 * (slope > 0)))

    assert all(abs(x["s"] - want(x["h"])) < 1e-9 for x in r)
    assert all(x["why"][0] == "gates" and 2 <= len(x["why"]) <= 3 for x in r)


def test_paths_with_buffers(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 0.0, 5.0, 10.0, 5.0), (3, 0.0, 9.0, 10.0, 9.0)], "id int, px double, py double, qx double, qy double")
    lines = spark.createDataFrame([(5.0, -1.0, 5.0, 1.0, None), (4.0, 6.5, 6.0, 8.0, 1.5)], "ax double, ay double, bx double, by double, buffer double")
    assert {r["id"] for r in spatial.blocked_paths(p, lines).collect()} == {1, 2, 3}
    assert {r["id"] for r in spatial.blocked_paths(p, lines.withColumn("buffer", F.col("buffer") - 0.6)).collect()} == {1}
    assert {r["id"] for r in spatial.blocked_paths(p, lines.drop("buffer")).collect()} == {1}


def test_archives_and_features(spark, tmp_path):
    depth = np.arange(6.0).reshape(2, 3) - 1
    np.savez(tmp_path / "f.npz", case_ids=np.array(["a", "b"]), water_depth_m=depth, velocity_u_ms=depth * 2, velocity_v_ms=np.where(depth > 3, np.nan, depth))
    f = tables.read_field_archive(spark, str(tmp_path / "f.npz"))
    assert got(f.select("case_id", "cell_id", "depth", "u"), "case_id", "cell_id") == [(c, k, depth[i, k], depth[i, k] * 2) for i, c in enumerate("ab") for k in range(3)]
    assert tuple(tables.field_problems(f).first()) == (6, 2, 1, 1, 0) and tables.field_problems(f.where("case_id = 'a' or cell_id > 0")).first()["uneven"] == 1
    assert tuple(tables.field_problems(f.where("cell_id > 9")).first()) == (0, 0, 0, 0, 0)
    np.savez(tmp_path / "g.npz", case_ids=np.array(["a"]), water_depth_m=depth, velocity_u_ms=depth, velocity_v_ms=depth)
    with pytest.raises(Exception, match="64-bit floats"):
        tables.read_field_archive(spark, str(tmp_path / "g.npz")).count()
    pts = [(1, "w", "Polygon", 0, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])] + [(2, "l", "LineString", 0, k, float(k), 2.0) for k in range(2)] + [(3, "p", "Point", 0, 0, 5.0, 6.0)]
    tables.write_geojson(spark.createDataFrame(pts, "ix int, kind string, geom_type string, ring int, k int, lng double, lat double"), str(tmp_path / "out"))
    back = tables.read_features(spark, str(tmp_path / "out"))
    assert got(back.select("kind", "geom_type", "coordinates"), "kind") == [("l", "LineString", "[[0.0,2.0],[1.0,2.0]]"), ("p", "Point", "[5.0,6.0]"), ("w", "Polygon", "[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]]")]
    raw = base64.b64encode(b"hello world").decode()
    parts = spark.createDataFrame([("a", 0, raw[:6]), ("a", 1, raw[6:]), ("b", 0, raw)], "archive string, ix int, part string")
    expected = spark.createDataFrame([("a", 11, hashlib.sha256(b"hello world").hexdigest()), ("b", 11, "0"), ("c", 1, "0")], "archive string, size int, sha256 string")
    assert got(tables.packed_problems(parts, expected), "archive") == [("b", "digest"), ("c", "missing")]


def test_rules(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, float("nan")), (2, 0.0, 1.0)], "index int, x double, y double")
    c = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 0, 9)], "index int, a int, b int, c int")
    f = spark.createDataFrame([(0, 0, 1, 0, None, 1.0), (1, 2, 2, 0, 7, 0.0)], "index int, a int, b int, left int, right int, length double")
    want = {("cell", 1, "repeated vertex"), ("cell", 1, "unknown vertex"), ("vertex", 1, "not finite"), ("face", 1, "repeated vertex"), ("face", 1, "unknown cell"), ("face", 1, "length")}
    assert {tuple(r) for r in tables.mesh_row_problems(c, v, f).collect()} == want
    m = spark.createDataFrame([("1", "A", "r"), ("1", "B", "r"), ("2", "C", None)], "code string, name string, river string")
    e = spark.createDataFrame([("1", "B", "r"), ("2", "C", "r"), ("3", "D", "r")], "code string, name string, river string")
    assert got(quality.station_identity(m, e), "code") == [("1", True, True, True), ("2", True, False, False), ("3", False, False, False)]
    missing, extra = quality.key_differences(F.array(F.lit("a"), F.lit("x")), F.array(F.lit("a"), F.lit("b")))
    assert tuple(spark.range(1).select(missing, extra).first()) == (["b"], ["x"])


@pytest.mark.parametrize("name", ["sites_cast_ring", "flow_site_scores", "raster_component_filter", "mesh_raster", "web_decode", "stream_summary"])
def test_scene_queries_run(spark, sf, name):
    from meshtide.plans import scene_queries
    from meshtide.plans.queries import QUERIES

    assert QUERIES[name](spark, sf).count() > 0 and scene_queries
