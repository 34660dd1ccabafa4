"""Small fixtures with known answers."""

import json
import math

import pytest
from pyspark.sql import functions as F

from meshtide.functions import geo, scalar
from meshtide.operators import ensemble, graph, mesh, quality, raster, series, spatial, web
from meshtide.sources import tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_ensemble_statistics(spark):
    data = []
    for i in range(16):
        for cell, angle in enumerate((0, math.pi / 2, math.pi, i * math.pi / 8)):
            wet = not (cell == 3 and i % 4 == 0)
            s = 0.1 * (i + 1) + 0.01 * cell if wet else 0.0
            data.append((f"c{i}", cell, 1 + 0.05 * i + 0.1 * cell if wet else 0.0, s * math.cos(angle), s * math.sin(angle)))
    r = {x["cell_id"]: x for x in ensemble.cell_statistics(spark.createDataFrame(data, "case_id string, cell_id int, depth double, u double, v double")).collect()}
    assert all(abs(r[c]["agreement"] - 1) < 1e-12 for c in (0, 1, 2)) and r[3]["agreement"] < 0.2
    assert r[3]["wet_probability"] == 0.75 and r[3]["active"] == 12 and r[0]["support"] == 1
    assert abs(r[0]["speed_median"] - 0.85) < 1e-12
    still = ensemble.cell_statistics(spark.createDataFrame([("a", 1, 1.0, 0.0, 0.0)], "case_id string, cell_id int, depth double, u double, v double")).first()
    assert still["direction"] is None and still["agreement"] == 0


def test_cases_and_runner(spark):
    c = spark.createDataFrame([(i, "completed" if i else "failed") for i in range(16)], "case_id int, status string")
    assert ensemble.completeness(c).first()[:2] == (15, 1)
    expected = spark.createDataFrame([(1,), (2,), (99,)], "case_id int")
    verdict = dict((r[0], r[2]) for r in ensemble.reconcile_cases(expected, c.union(c.where("case_id = 2"))).collect())
    assert verdict[1] == "ok" and verdict[2] == "duplicate" and verdict[99] == "missing" and verdict[5] == "unknown"

    def solver(rows):
        if rows["case_id"].iloc[0] == 6:
            raise ValueError("synthetic divergence")
        return rows.assign(x=rows["case_id"] * 2.0)[["case_id", "x"]]

    r = {x["case_id"]: x for x in ensemble.run_ensemble(spark.range(8).withColumnRenamed("id", "case_id"), solver, "case_id long, x double").collect()}
    assert r[6]["status"] == "failed" and r[6]["failure_reason"] == "ValueError: synthetic divergence" and r[3]["x"] == 6.0


def test_design_strata(spark):
    d = ensemble.stratified_design(spark, spark.createDataFrame([("a", 0.0, 1.0), ("b", 5.0, 9.0)], "name string, low double, high double"), 64, 3).toPandas()
    a = d[d.name == "a"].value
    assert sorted((a * 64).astype(int)) == list(range(64)) and d[d.name == "b"].value.between(5, 9).all()


def test_interpolation_and_order(spark):
    s = spark.createDataFrame([("m", 0.0, 0.0), ("m", 3600.0, 1.0), ("m", 7200.0, 0.0)], "series_id string, t double, value double")
    q = spark.createDataFrame([("m", 1800.0), ("m", -100.0), ("m", 7300.0), ("m", 3600.0), ("none", 1.0)], "series_id string, t double")
    assert rows(series.interpolate_at(s, q), "series_id", "t") == [("m", -100.0, 0.0), ("m", 1800.0, 0.5), ("m", 3600.0, 1.0), ("m", 7300.0, 0.0), ("none", 1.0, None)]
    strict = dict((r[1], r[2]) for r in series.interpolate_at(s, q.where("series_id = 'm'"), "error").collect())
    assert strict[-100.0] is None and strict[3600.0] == 1.0
    o = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 2.0), ("b", 1, 2.0)], "series_id string, ordinal int, t double")
    assert rows(series.order_violations(o), "series_id") == [("a", 2, 0, True), ("b", 2, 1, False)]


def test_hysteresis(spark):
    h = [0.0007, 0.0008, 0.0006, 0.0009, 0.0011, 0.0008, 0.0006, 0.0004, 0.001, 0.0005]
    d = spark.createDataFrame([(1, k, x) for k, x in enumerate(h)], "cell int, step int, h double")
    r = series.hysteresis(d).orderBy("step").collect()
    assert [x["wet"] for x in r] == [0, 0, 0, 0, 1, 1, 1, 0, 1, 0] and sum(x["newly_wet"] for x in r) == 2 and sum(x["newly_dry"] for x in r) == 2
    cells = spark.createDataFrame([(0, 4e-4, 9.0, -7.0, 2.0, 0), (1, 1.0, 2.0, 1.0, 3.0, 1)], "cell int, h double, hu double, hv double, area double, wet int")
    z = series.regularised(cells).orderBy("cell").collect()
    assert abs(z[0]["removed"] - 8e-4) < 1e-15 and abs(math.hypot(z[1]["u"], z[1]["v"]) - 2) < 1e-12


def test_coverage_and_orders(spark):
    c = spark.createDataFrame([("v", 0, 2), ("v", 2, 2), ("f", 0, 2), ("f", 3, 1)], "kind string, start long, count long")
    n = spark.createDataFrame([("v", 4), ("f", 4), ("x", 1)], "kind string, total long")
    assert rows(series.chunk_coverage(c, n).select("kind", "complete"), "kind") == [("f", False), ("v", True), ("x", False)]
    lv = spark.createDataFrame([("g", h, e) for h, e in ((0.2, 0.04), (0.1, 0.01), (0.05, 0.0025))], "group string, h double, error double")
    assert [round(r["order"], 9) for r in series.convergence_orders(lv).orderBy(F.desc("h")).collect() if r["order"]] == [2, 2]


def test_raster_round_trip(spark):
    r = spark.createDataFrame([(0, 1, 3), (0, 5, 5), (1, 3, 5), (3, 0, 0)], "row int, x0 int, x1 int")
    assert rows(raster.encode_runs(raster.decode_runs(r)), "row", "x0") == rows(r, "row", "x0")
    assert raster.pixel_count(r).first()[0] == 8
    assert raster.run_components(r).select("component").distinct().count() == 2
    assert rows(raster.raster_diff(r, r.where("row = 0").union(spark.createDataFrame([(1, 3, 6)], r.schema))), "row") == [(1, 1, 0), (3, 0, 1)]
    p = spark.createDataFrame([(1, 3.9, 0.2), (2, 4.0, 0.0), (3, 5.5, 0.0)], "id int, px double, py double")
    assert rows(raster.point_in_runs(p, r).select("id"), "id") == [(1,), (3,)]
    assert rows(raster.point_in_runs(p, r, rounding="half_even").select("id"), "id") == []
    bad = spark.createDataFrame([(0, 0, 1, 4), (0, 1, 3, 6), (9, 0, 0, 1)], "row int, run_ix int, x0 int, x1 int")
    assert rows(raster.run_validity(bad, 10, 5).select("row", "reason"), "row") == [(0, "overlap"), (9, "range")]


def test_components_brute_force(spark):
    import random

    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is None:
            find(b)
        else:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in root}
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    low = {}
    for x, r in want.items():
        low[r] = min(low.get(r, x), x)
    assert got == {x: low[r] for x, r in want.items()}
    assert graph.connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_graph_balance(spark):
    e = spark.createDataFrame([(0, 0, 1, 1.2), (1, 1, 2, 0.8), (2, 2, 3, 1.1), (3, 3, 4, 0.9), (4, 4, 5, 1.3), (5, 1, 4, 0.4)], "edge_id int, left int, right int, w double")
    n = spark.createDataFrame(list(enumerate([0.1, 0.3, 0.55, 0.7, 0.85, 0.95])), "node_id int, value double")
    r = [x["residual"] for x in graph.node_balance(e, n).collect()]
    assert abs(sum(r)) < 1e-12 and max(map(abs, r)) > 0
    assert all(x["residual"] == 0 for x in graph.node_balance(e, n.withColumn("value", F.lit(0.5))).collect())
    lim = graph.drain_limiter(spark.createDataFrame([(0, 0, 1, 2.0), (1, 1, 2, -4.0)], "face_id int, left int, right int, flux double"), spark.createDataFrame([(0, 1.0), (2, 10.0)], "cell_id int, available double"), 1.0)
    assert [r["alpha"] for r in lim.orderBy("face_id").collect()] == [0.5, 1.0]
    t = spark.createDataFrame([("N", -4.0)], "id string, total double")
    f = spark.createDataFrame([("N", 0, 1.0), ("N", 1, 3.0), ("O", 0, 1.0)], "id string, ix int, length double")
    assert rows(graph.distribute_by_length(t, f), "id", "ix") == [("N", 0, -1.0), ("N", 1, -3.0), ("O", 0, None)]
    m = graph.edge_multipliers(spark.range(5).withColumnRenamed("id", "edge_id"), spark.createDataFrame([(3, 1), (4, 2)], "edge_id long, gate int"), spark.createDataFrame([(1, 0.25), (None, 0.4)], "gate int, opening double"))
    assert rows(m, "edge_id") == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 0.25), (4, 0.4)]


def test_mesh(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0)], "vertex_id int, x double, y double")
    t = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 3, 2)], "cell_id int, a int, b int, c int")
    g = mesh.triangle_geometry(t, v).orderBy("cell_id").collect()
    assert [(r["a"], r["b"], r["c"]) for r in g] == [(0, 1, 2), (0, 2, 3)] and sum(r["area"] for r in g) == 1
    e = mesh.edge_incidence(t)
    assert dict(e.groupBy("kind").count().collect()) == {"interior": 1, "boundary": 4}
    p = spark.createDataFrame([(0, 0.75, 0.25), (1, 0.25, 0.75), (2, 1.2, 0.5)], "point_id int, x double, y double")
    assert rows(mesh.locate_in_mesh(p, t, v, 0.5), "point_id") == [(0, 0), (1, 1), (2, None)]
    assert all(r["ok"] for r in mesh.mesh_audit(t, v).collect())
    bad = t.union(spark.createDataFrame([(2, 0, 1, 3), (3, 0, 1, 2)], t.schema))
    assert not all(r["ok"] for r in mesh.mesh_audit(bad, v).collect())
    assert all(abs(r["nx"]) < 1e-12 and abs(r["ny"]) < 1e-12 for r in mesh.closure_check(e, v, mesh.triangle_geometry(t, v)).collect())
    faces = mesh.face_geometry(e, v, mesh.triangle_geometry(t, v)).select(F.col("lo").alias("a"), F.col("hi").alias("b"), "left", "right", "length")
    longer = faces.withColumn("length", F.when(F.col("right").isNotNull(), F.col("length") * 1.01).otherwise(F.col("length")))
    assert abs(mesh.compare_faces(longer, faces).first()["length_error"] - 0.01) < 2e-3 and mesh.compare_faces(faces, faces).first()["length_error"] == 0


def test_quality(spark):
    s = spark.createDataFrame([("g", 1.1, 1.0, 1.0), ("g", 1.8, 2.0, 2.0), ("g", 3.3, 3.0, 1.0)], "group string, numerical double, reference double, weight double")
    r = quality.error_norms(s).first()
    assert abs(r["l1"] - 0.2) < 1e-12 and abs(r["l2"] - math.sqrt(0.045)) < 1e-12 and abs(r["linf"] - 0.3) < 1e-12
    p = spark.createDataFrame([("g", (k + 0.5) / 20, 0.35 * math.cos(math.pi * (k + 0.5) / 200), 1.0) for k in range(200)], "group string, x double, value double, weight double")
    assert abs(quality.mode_projection(p, 1, 10.0).first()["amplitude"] - 0.35) < 1e-12
    reg = spark.createDataFrame([(str(k), "p", ["t"], [("e", "lte", 0.1, None)]) for k in range(4)], "id string, purpose string, required_for array<string>, criteria array<struct<metric string, operator string, target double, high double>>")
    res = spark.createDataFrame([("0", "p", {"e": 0.1}), ("1", "p", {"e": 0.2}), ("2", "q", {"e": 0.0})], "id string, purpose string, metrics map<string,double>")
    assert rows(quality.evaluate_registry(reg, res, "t"), "id") == [("0", "passed"), ("1", "failed"), ("2", "invalid"), ("3", "missing")]
    c = spark.createDataFrame([("r", "completed", 1.0, 1e-12, 0.95001, 1.0)], "run_id string, status string, wall_s double, mass_error double, cfl double, min_depth double")
    assert {x["check"] for x in quality.run_evaluation(c, {"cfl": 0.95, "mass": 1e-8}).where("not ok").collect()} == {"cfl"}


def test_spatial(spark):
    square = [(0, 0, 0.0, 0.0, 4.0, 0.0), (0, 0, 4.0, 0.0, 4.0, 4.0), (0, 0, 4.0, 4.0, 0.0, 4.0), (0, 0, 0.0, 4.0, 0.0, 0.0), (0, 1, 1.0, 1.0, 2.0, 1.0), (0, 1, 2.0, 1.0, 2.0, 2.0), (0, 1, 2.0, 2.0, 1.0, 2.0), (0, 1, 1.0, 2.0, 1.0, 1.0)]
    e = spark.createDataFrame(square, "feature int, ring int, ax double, ay double, bx double, by double")
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 5.0, 1.0)], "id int, x double, y double")
    assert rows(spatial.point_in_polygon(p, e, 1.5), "id") == [(1, 0)]
    t = spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "id int, x double, y double, score double")
    s = spark.createDataFrame([(5, 34.0, 0.0), (6, 0.0, 34.0), (7, 1.0, 0.0), (8, 300.0, 0.0)], "id int, x double, y double")
    assert spatial.best_stand(t, s).first()["stand"] == 5
    wall = spark.createDataFrame([(10.0, -5.0, 10.0, 5.0)], "ax double, ay double, bx double, by double")
    assert spatial.best_stand(t, s, blocked_by=wall).first()["stand"] == 6
    c = spark.createDataFrame([("s", k, float(k * 50), 0.0, float(k * 50), 10.0, 1.0 - k / 100) for k in range(10)], "scene string, id int, tx double, ty double, sx double, sy double, score double")
    assert [r["id"] for r in spatial.hotspots(c, 3).orderBy("rank").collect()] == [0, 2, 4]
    line = spatial.polyline_measure(spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 10.0)], "line_id int, ix int, x double, y double"))
    n = spatial.nearest_axis(spark.createDataFrame([(1, 5.0, 2.0)], "id int, x double, y double"), line).first()
    assert (n["d"], n["offset"], n["progress"]) == (2.0, 2.0, 0.25)


def test_stations(spark):
    d = spark.range(1).select(geo.haversine(F.lit(33.8905556), F.lit(130.6736111), F.lit(33.8905556), F.lit(130.6736111)).alias("a"), geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("b")).first()
    assert d["a"] == 0 and abs(d["b"] - 6371008.8 * math.pi / 180) < 1e-6
    x, y = geo.web_mercator(F.lit(33.9), F.lit(130.7))
    lat, lng = geo.web_mercator_inverse(x, y)
    r = spark.range(1).select(lat.alias("lat"), lng.alias("lng")).first()
    assert abs(r["lat"] - 33.9) < 1e-9 and abs(r["lng"] - 130.7) < 1e-9


def test_scalars(spark):
    one = spark.range(1)
    assert one.select(scalar.fnv1a32(F.lit("a"))).first()[0] == "e40c292c" and one.select(scalar.fnv1a32(F.lit(""))).first()[0] == "811c9dc5"
    assert one.select(scalar.safe_name(F.lit(" a b/c? "))).first()[0] == "a_b_c"
    assert one.select(scalar.palette(F.lit(0.5), F.lit(0.0), F.lit(1.0), [(0, 0, 0), (255, 101, 10)])).first()[0] == [128, 50, 5]
    r = one.select(scalar.redact(F.lit("x token=abc https://a.b/c?d=1\n Bearer q"))).first()[0]
    assert "abc" not in r and "d=1" not in r and "\n" not in r
    assert one.select(scalar.parse_iso_with_zone(F.lit("2026-07-12T00:00:00+09:00"))).first()[0] == 1783782000.0
    assert one.select(scalar.parse_iso_with_zone(F.lit("2026-07-12T00:00:00"))).first()[0] is None
    assert str(one.select(scalar.parse_multi_format(F.lit("202607120130"))).first()[0]) == "2026-07-12 01:30:00"


def test_sources(spark, tmp_path):
    (tmp_path / "c0.json").write_text(json.dumps({"startRow": 0, "rows": [[1, 2, 5, 6], []]}))
    (tmp_path / "c1.json").write_text(json.dumps({"startRow": 2, "rows": [[0, 9]]}))
    assert rows(tables.read_raster(spark, str(tmp_path)), "row", "run_ix") == [(0, 0, 1, 2), (0, 1, 5, 6), (2, 0, 0, 9)]
    chunks = spark.read.schema(tables.RASTER_CHUNK).json(str(tmp_path), multiLine=True)
    assert rows(tables.raster_problems(chunks, 4), "row") == [(3, "missing")]
    v = spark.createDataFrame([(k, float(k), float(-k)) for k in range(5)], "index long, x double, y double")
    m = tables.mesh_chunks(v, "vertices", "index", 2)
    assert m.count() == 3 and tables.broken_chunks(m).count() == 0 and rows(tables.mesh_rows(m, "vertices", ["x", "y"]), "index") == rows(v, "index")
    assert tables.broken_chunks(m.withColumn("checksum", F.lit("00000000"))).count() == 3
    g = tmp_path / "g.geojson"
    g.write_text(json.dumps({"features": [{"type": "Feature", "properties": {"kind": "water"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}]}))
    assert tables.closed_segments(tables.rings(tables.read_geojson(spark, str(g)))).count() == 3
    man = tables.file_manifest(spark, str(tmp_path))
    assert tables.verify_manifest(man, man.where("path not like '%c0%'")).first()["problem"] == "extra"


def test_packed_and_json(spark):
    import base64
    import gzip

    import numpy as np

    raw = gzip.compress(np.arange(6, dtype="<i4").tobytes() + bytes([7, 8]))
    b = base64.b64encode(raw).decode()
    parts = spark.createDataFrame([("a", 0, b[:12]), ("a", 1, b[12:])], "archive string, ix int, part string")
    r = tables.packed_arrays(parts, [("v", "<i4", 0, 3, 2), ("m", "u1", 24, 2, 1)])
    assert [x[0] for x in r.where("name = 'v'").orderBy("row", "col").select("value").collect()] == [0, 1, 2, 3, 4, 5] and r.count() == 8
    j = web.flattened(spark.createDataFrame([(1, '{"a": [1, {"b": "x"}], "c": null}')], "id int, j string"), "id", "j")
    assert ("$.a[1].b", "x") in {(x["path"], x["value"]) for x in j.collect()}


def test_stream_equals_batch(spark, tmp_path):
    import datetime as dt

    from meshtide.streaming import stateful

    h = [0.0007, 0.0011, 0.0008, 0.0004, 0.0012]
    t0 = dt.datetime(2026, 1, 1)
    d = spark.createDataFrame([(c, t0 + dt.timedelta(minutes=k), x) for c in (1, 2) for k, x in enumerate(h)], "cell int, ts timestamp, h double")
    closing = spark.createDataFrame([(9, t0 + dt.timedelta(days=1), 0.0)], d.schema)  # moves the watermark past all others
    d.union(closing).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = stateful.stream_hysteresis(stream).writeStream.format("memory").queryName("wetdry").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = rows(spark.table("wetdry").where("cell < 9").select("cell", "ts", "wet"), "cell", "ts")
    want = rows(series.hysteresis(d, key="cell", order="ts").select("cell", "ts", "wet"), "cell", "ts")
    assert got == want


@pytest.mark.parametrize("name", ["ensemble_cell_statistics", "raster_components", "mesh_audit", "spatial_hotspots", "text_redact", "spatial_nearest_axis"])
def test_queries_run(spark, sf, name):
    from meshtide.plans.queries import QUERIES

    assert QUERIES[name](spark, sf).count() > 0
