"""Small fixtures with known answers: maps, rules, audits, percentiles, tiles, patches, parameters, files and the run monitor."""

import datetime as dt
import json
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meshtide.functions import geo, scalar
from meshtide.operators import ensemble, graph, mesh, quality, raster, series, spatial, web
from meshtide.sources import tables
from meshtide.streaming import stateful


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_small_maps(spark):
    x, y = F.lit(3.0), F.lit(4.0)
    there = geo.similarity(x, y, 0.5, 0.25, 1.0, 2.0)
    assert one(spark, *geo.similarity_inverse(*there, 0.5, 0.25, 1.0, 2.0)) == pytest.approx((3.0, 4.0))
    assert one(spark, *geo.two_point_similarity(x, y, ((0, 0), (3, 4)), ((10, 10), (14, 13)))) == pytest.approx((14.0, 13.0))
    assert one(spark, *geo.local_ll(*geo.local_xy(F.lit(33.9), F.lit(130.7), 33.87, 130.68), 33.87, 130.68)) == pytest.approx((33.9, 130.7))
    edge = lambda lat, lng: geo.near_map_edge(F.lit(lat), F.lit(lng), 33.0, 34.0, 130.0, 131.0)
    assert one(spark, edge(33.5, 130.5), edge(33.0001, 130.5), edge(33.5, 130.9999)) == (False, True, True)
    d = one(spark, geo.mean_latitude_distance(F.lit(33.0), F.lit(130.0), F.lit(33.01), F.lit(130.02)))[0]
    assert d == pytest.approx(math.hypot(0.02 * 111320 * math.cos(math.radians(33.005)), 0.01 * 111320))


def test_rules_and_rankings(spark):
    ok = [scalar.criterion(F.lit(2.0), F.lit(k), F.lit(2.0), F.lit(3.0)) for k in ("lte", "gte", "eq", "between", "near")]
    assert one(spark, *ok) == (True, True, True, True, None)
    assert one(spark, quality.conservation_error(F.lit(2.0), F.lit(5.0), F.lit(1.0)), quality.conservation_error(F.lit(2.0), F.lit(5.0), F.lit(1.0), F.lit(4.0))) == pytest.approx((0.4, 0.5))
    weighed = spark.createDataFrame([(2.0, 3.0), (1.0, 0.5)], "value double, weight double")
    assert graph.integral(weighed).first()[0] == 6.5 and graph.integral(weighed.union(spark.createDataFrame([(1.0, -1.0)], weighed.schema))).first()[0] is None
    tiers = spark.createDataFrame([("a", 1, 10.0), ("b", 2, 10.0), ("c", 3, 10.0)], "tier string, ix int, limit_s double")
    assert rows(quality.tier_evaluation(spark.createDataFrame([("a", 9.0), ("b", 11.0)], "tier string, wall_s double"), tiers), "tier") == [("a", True, "b"), ("b", False, None), ("c", False, None)]
    c = spark.createDataFrame([("p", "x", "full"), ("p", "y", "partial"), ("q", "x", "none"), ("r", "x", "full"), ("r", "y", "partial")], "candidate string, objective string, capability string")
    got = quality.suitability(c, spark.createDataFrame([("x", 3.0), ("y", 1.0)], "objective string, weight double"))
    assert [(r["candidate"], round(r["score"], 6), r["unmet"], r["partial"], r["rank"]) for r in got.orderBy("candidate").collect()] == [("p", 0.8375, 0, 1, 1), ("q", 0.0, 2, 0, 3), ("r", 0.8375, 0, 1, 1)]
    spots = spark.createDataFrame([("s", 1, 0.5), ("s", 2, 0.875), ("s", 3, 0.5), ("t", 4, None)], "scene string, id int, score double")
    assert rows(spatial.ranked(spots, "scene").select("id", "rank", "score100"), "id") == [(1, 2, 50), (2, 1, 88), (3, 3, 50), (4, 1, None)]


def test_web_lists(spark):
    urls = F.array(*[F.lit(u) for u in ("https://b.org/x", "http://a.org/", "https://a.org:443/1", "https://evil.org/?a.org", "https://a.org:443/1")])
    assert one(spark, web.allowed_urls(urls, ["a.org", "b.org"]))[0] == ["https://b.org/x", "https://a.org:443/1"]
    d = spark.createDataFrame([("g", "v", 3), ("g", "v", 1), ("g", None, 0), ("h", "v", 2)], "g string, v string, at int")
    assert rows(web.distinct_in_order(d, "g", "v", "at"), "g") == [("g", "v", 1), ("h", "v", 2)]


def test_decoded_sources(spark):
    bodies = [(1, "é".encode("latin-1"), "text/html; charset=latin-1"), (2, b'<meta charset="cp932">' + "川".encode("cp932"), None), (3, "川".encode(), "charset=nonsense"), (4, None, "charset=utf-8"), (5, b"\x81", None), (6, b"", None)]
    got = rows(web.decoded(spark.createDataFrame(bodies, "id int, body binary, kind string"), "body", "kind").select("id", "text", "encoding"), "id")
    assert got[:4] == [(1, "é", "latin-1"), (2, '<meta charset="cp932">川', "cp932"), (3, "川", "utf-8"), (4, None, None)] and got[4][2] == "utf-8-replace" and got[5][1:] == ("", "utf-8")


@pytest.mark.parametrize("small", [3, 40, 100_000])
def test_percentiles_against_sorting(spark, small):
    rng = random.Random(small)
    values = [float(rng.randrange(500)) for _ in range(700)] + [77.0] * 400 + [rng.gauss(0, 1) for _ in range(300)]
    d = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    at = sorted(values)

    def want(p):
        k = p * (len(at) - 1)
        return at[math.floor(k)] + (at[math.ceil(k)] - at[math.floor(k)]) * (k - math.floor(k))

    p = (0.0, 0.02, 0.5, 0.98, 1.0)
    assert ensemble.exact_percentiles(d, "v", p, small) == pytest.approx([want(q) for q in p])
    assert ensemble.exact_percentiles(d.where("v is null"), "v", (0.5,)) == [None]
    assert ensemble.color_range(d.where("v = 77"), "v").first()[:] == (77.0, 77.0) and ensemble.color_range(d.where("v is null"), "v").first()[:] == (None, None)


def test_halfplane_keeps_null_cells(spark):
    d = spark.createDataFrame([(1, 1.0, 0.0), (1, 1.0, 1.0), (1, -1.0, 0.0), (None, 0.0, 1.0), (2, 1.0, 0.0), (2, -1.0, 0.0)], "cell_id int, u double, v double")
    assert rows(ensemble.halfplane_agreement(d), "cell_id") == [(None, 1.0), (1, pytest.approx(2 / 3)), (2, 0.0)]


def lattice(spark, n=3):
    v = [(y * (n + 1) + x, float(x), float(y)) for x in range(n + 1) for y in range(n + 1)]
    t = []
    for x in range(n):
        for y in range(n):
            p = y * (n + 1) + x
            t += [(len(t), p, p + 1, p + n + 2), (len(t) + 1, p, p + n + 1, p + n + 2)]
    return spark.createDataFrame(t, "cell_id int, a int, b int, c int"), spark.createDataFrame(v, "vertex_id int, x double, y double")


def test_audit_finds_each_fault(spark):
    t, v = lattice(spark)
    f = mesh.face_geometry(mesh.edge_incidence(t), v, mesh.triangle_geometry(t, v)).withColumnsRenamed({"lo": "a", "hi": "b"}).withColumn("marker", F.when(F.col("kind") == "boundary", "wall"))
    f = spark.createDataFrame(f.collect(), f.schema)
    inner, outer = (f.where(F.col("kind") == k).orderBy("a", "b").first() for k in ("interior", "boundary"))
    is_ = lambda r: (F.col("a") == r["a"]) & (F.col("b") == r["b"])
    off = lambda r, k, value: {"faces": f.withColumn(k, F.when(is_(r), value).otherwise(F.col(k)))}
    faults = [
        ({}, set()), ({"vertices": v.where("vertex_id > 0")}, {"vertex count"}), ({"triangles": t.where("cell_id > 0")}, {"cell count", "triangle vertex sets"}), ({"triangles": t.withColumn("a", F.when(F.col("cell_id") == 0, 9).otherwise(F.col("a")))}, {"triangle vertex sets"}),
        ({"faces": f.where(~is_(inner))}, {"interior face count", "interior edges"}), ({"faces": f.union(f.where(is_(outer)))}, {"boundary face count", "boundary edges"}), (off(inner, "left", 99), {"interior cells"}), (off(outer, "left", 99), {"boundary cells"}),
        (off(inner, "length", 5.0), {"interior length error"}), (off(outer, "length", 5.0), {"boundary length error"}), (off(inner, "centre_distance", 5.0), {"interior centre distance error"}), (off(inner, "mx", 9.0), {"interior midpoint error"}),
        (off(outer, "my", 9.0), {"boundary midpoint error"}), (off(outer, "marker", "gate"), {"boundary markers"}), (off(inner, "right", None), {"interior face count", "interior edges", "boundary face count", "boundary edges"}),
    ]
    out = None
    for k, (change, _) in enumerate(faults):
        exported = {"vertices": v, "triangles": t, "faces": f} | change
        a = mesh.mesh_audit(t, v, exported, markers=f.where("kind = 'boundary'")).select(F.lit(k).alias("k"), "check", "ok")
        out = a if out is None else out.union(a)
    got = out.collect()
    assert len(got) == 20 * len(faults)
    for k, (_, names) in enumerate(faults):
        assert {r["check"] for r in got if r["k"] == k and not r["ok"]} == names, k


def test_quantised(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.002)], "id int, x double, y double")
    assert rows(mesh.quantised(d).select("id", "qx", "qy"), "id") == [(1, -500, -1), (2, 500, 1)]


def test_tiles_and_patches(spark):
    r = spark.createDataFrame([("a", 0, 0, 3), ("b", 0, 2, 5), ("a", 0, 4, 6), ("a", 1, 1, 1)], "tile string, row int, x0 int, x1 int")
    keys = ("tile", "row")
    assert rows(raster.merged_runs(r, keys=keys), *keys) == [("a", 0, 0, 6), ("a", 1, 1, 1), ("b", 0, 2, 5)]
    assert rows(raster.encode_runs(raster.decode_runs(r, keys), keys), *keys) == rows(raster.merged_runs(r, keys=keys), *keys)
    patch = spark.createDataFrame([("a", 0, 9, 9)], r.schema)
    patched = raster.patched_runs(r, patch, keys)
    assert rows(patched, *keys) == [("a", 0, 9, 9), ("a", 1, 1, 1), ("b", 0, 2, 5)]
    assert rows(raster.raster_diff(r, patched, keys), *keys) == [("a", 0, 1, 7)]
    assert raster.only_added(r, patched, keys).first()[:] == (1, 7, False) and raster.only_added(r, r.union(patch), keys).first()[:] == (1, 0, True) and raster.only_added(r.limit(0), r.limit(0), keys).first()[:] == (0, 0, True)


def test_safe_hotspots(spark):
    spots = [("s", 1, 0.0, 0.0, 10.0, 0.0, 0.9), ("s", 2, 50.0, 50.0, 60.0, 50.0, 0.8), ("s", 3, 50.0, 0.0, 60.0, 0.0, 0.7), ("s", 4, 90.0, 90.0, 95.0, 90.0, 0.6)]
    d = spark.createDataFrame(spots, "scene string, id int, tx double, ty double, sx double, sy double, score double")
    excluded = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 1.0)], "ax double, ay double, bx double, by double, buffer double")
    wall = spark.createDataFrame([(55.0, -10.0, 55.0, 10.0)], "ax double, ay double, bx double, by double")
    assert rows(spatial.safe_hotspots(d, excluded, wall).select("id", "rank", "score100"), "id") == [(2, 1, 80), (4, 2, 60)]


def test_parameter_forms(spark):
    at = spark.createDataFrame([(1, 0.5), (1, 0.5), (1, 9.0), (2, 1.0)], "series_id int, t double")
    s = spark.createDataFrame([(1, 0.0, 10.0), (1, 1.0, 20.0)], "series_id int, t double, value double")
    got = series.with_parameter(series.with_parameter(series.with_parameter(at, "k", s), "c", 2.0), "d", F.col("t") * 2)
    assert rows(got, "series_id", "t") == [(1, 0.5, 15.0, 2.0, 1.0), (1, 0.5, 15.0, 2.0, 1.0), (1, 9.0, 20.0, 2.0, 18.0), (2, 1.0, None, 2.0, 2.0)]


def test_written_statistics(spark, tmp_path):
    stats, summary = spark.createDataFrame([(1, 0.5)], "cell_id int, median double"), spark.createDataFrame([(7,)], "cases int")
    tables.write_statistics(stats, summary, str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out/cells")), "cell_id") == [(1, 0.5)] and [json.loads(p.read_text()) for p in Path(tmp_path / "out/summary").glob("part-*.json") if p.stat().st_size] == [{"cases": 7}]
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_statistics(stats, summary, str(tmp_path / "out"))


def test_run_monitor(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    cases = [("r", t0, 1, 0.5, 0.0), ("r", t0 + dt.timedelta(minutes=1), 2, 0.99, 0.0), ("r", t0 + dt.timedelta(minutes=2), 3, 0.99, 1.0), ("q", t0, 4, 0.1, None), ("p", t0, 5, 0.1, 0.0), ("p", t0 + dt.timedelta(days=1), 6, 0.1, 0.0)]
    d = spark.createDataFrame(cases, "run_id string, ts timestamp, case_id int, cfl double, mass double")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = stateful.stream_violations(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), {"cfl": 0.95, "mass": 1e-8})
    q = found.writeStream.format("memory").queryName("monitor").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert rows(spark.table("monitor").select("run_id", "case_id", "reason"), "run_id") == [("q", "4", "mass missing"), ("r", "2", "cfl")]
