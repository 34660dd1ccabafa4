"""Jobs that need a mechanism of their own, against brute force."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshtide.functions import scalar
from meshtide.operators import ensemble, graph, quality, raster, series, spatial, web
from meshtide.sources import chunked, tables
from meshtide.streaming import stateful


def brute_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components_without_cut_edges(spark, monkeypatch):
    rng = np.random.default_rng(1)
    edges = np.stack([rng.integers(0, 400, 330), rng.integers(0, 400, 330)], 1).tolist()
    cut = [tuple(e[::-1]) for e in edges[::6]] + [(9_999, 3)]
    kept = [e for e in edges if tuple(e) not in cut and tuple(e[::-1]) not in cut] + [(x, x) for e in edges for x in e]
    df = spark.createDataFrame(pd.DataFrame(edges, columns=["src", "dst"])).repartition(5)
    gone = spark.createDataFrame(pd.DataFrame(cut, columns=["src", "dst"]))
    monkeypatch.setattr(graph, "CHUNK_EDGES", 16)
    for near in (None, F.floor(F.col("src") / 50)):
        assert {r["node"]: r["component"] for r in graph.connected_components(df, near=near).collect()} == brute_components(edges)
        assert {r["node"]: r["component"] for r in graph.connected_components(df, cut=gone, near=near).collect()} == brute_components(kept)
    assert graph.connected_components(df.limit(0), cut=gone).count() == 0


def test_run_components_over_tiles(spark):
    rng = np.random.default_rng(2)
    cells = {(int(x), int(y)) for x, y in rng.integers(0, 40, (900, 2))}
    edges = [((x, y), o) for x, y in cells for o in ((x, y), (x + 1, y), (x, y + 1)) if o in cells]
    want = brute_components(edges)
    df = spark.createDataFrame([(y, x, x) for x, y in cells], "row int, x0 int, x1 int")
    for tile in (8, 1000):
        got = raster.run_components(df, tile).select("row", "component", F.explode(F.sequence("x0", "x1")).alias("x")).collect()
        groups = {}
        for r in got:
            groups.setdefault(r["component"], set()).add((r["x"], r["row"]))
        by_root = {}
        for c, r in want.items():
            by_root.setdefault(r, set()).add(c)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, by_root.values()))


T0 = dt.datetime(2026, 1, 1)


def streamed(spark, tmp_path, job, batches, kind, name):
    """Rows of a streaming job over batches, each a file that is read on its own, in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = job(source).writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
        assert q.awaitTermination(180)
    return spark.read.parquet(str(tmp_path / "out"))


def test_stream_takes_late_rows_in_event_time(spark, tmp_path):
    """The case of a row that comes after its successors but within the watermark, and shuffled batches of random depths."""
    rng = np.random.default_rng(5)
    depths = [(1, 0, 1.0), (1, 20, 1.0), (1, 10, 0.0), (1, 30, 0.0007)]
    rows = [(c, T0 + dt.timedelta(minutes=m), h) for c, m, h in depths]
    rows += [(c, T0 + dt.timedelta(minutes=int(m)), float(rng.choice([0.0002, 0.0007, 0.0015]))) for c in (2, 3) for m in range(0, 50, 2)]
    order = rng.permutation(len(rows) - 4) + 4
    batches = [rows[:2] + [rows[k] for k in order[:20]], [rows[2]] + [rows[k] for k in order[20:40]], [rows[3]] + [rows[k] for k in order[40:]], [(9, T0 + dt.timedelta(days=2), 1.0)]]
    kind = "cell int, ts timestamp, h double"
    got = streamed(spark, tmp_path, stateful.stream_hysteresis, batches, kind, "late").where("cell < 9").orderBy("cell", "ts").collect()
    want = series.hysteresis(spark.createDataFrame(rows, kind), key="cell", order="ts").orderBy("cell", "ts").collect()
    assert [(r["cell"], r["ts"], r["wet"]) for r in got] == [(r["cell"], r["ts"], r["wet"]) for r in want]
    assert [r["change"] == "wetting" for r in got] == [r["newly_wet"] for r in want] and [r["change"] == "drying" for r in got] == [r["newly_dry"] for r in want]
    assert [r["wet"] for r in got if r["cell"] == 1] == [1, 0, 1, 1]


def test_stream_reports_the_earliest_violation(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    batches = [[("a", at(30), 7, 2.0, 0.0), ("a", at(5), 1, 0.1, 0.0), ("b", at(3), 4, None, 0.0), (None, at(2), 3, 9.0, 0.0)], [("a", at(10), 2, 0.2, 1.0), ("a", at(10), 3, 3.0, 0.0), ("b", at(50), 5, 5.0, 0.0)], [("z", at(3000), 9, 0.0, 0.0)], [("z", at(6000), 9, 8.0, 0.0)], [("a", at(6100), 8, 9.0, 9.0)]]
    got = streamed(spark, tmp_path, lambda d: stateful.stream_violations(d, {"cfl": 0.95, "mass": 1e-8}), batches, "run_id string, ts timestamp, case_id long, cfl double, mass double", "first").collect()
    assert sorted((r["run_id"] or "", r["ts"], r["case_id"], r["reason"]) for r in got) == [("", at(2), "3", "cfl"), ("a", at(10), "2", "mass"), ("b", at(3), "4", "cfl missing"), ("z", at(6000), "9", "cfl")]


def test_chunks_behind_a_manifest(spark, tmp_path):
    """Round trip with the writer's manifest, pushdown seen in the partitions, broken chunks in quarantine."""
    cells = spark.createDataFrame([(k, k + 0.5, k * 2.0, -k * 1.0) for k in range(95)], "index long, a double, b double, c double")
    faces = spark.createDataFrame([(k, 1.0, 2.0) for k in range(25)], "index long, a double, b double")
    chunks = tables.mesh_chunks(cells, "triangle", "index", 10).unionByName(tables.mesh_chunks(faces, "face", "index", 10))
    manifest = chunked.write_chunks(chunks, str(tmp_path / "mesh"))
    every = chunked.read_chunks(spark, manifest)
    assert every.rdd.getNumPartitions() == 13 and every.where("problem is not null").count() == 0
    some = every.where("kind = 'triangle' and index >= 30 and index < 45")
    assert some.rdd.getNumPartitions() == 2 and sorted(r["index"] for r in some.collect()) == list(range(30, 45))
    narrow = chunked.read_chunks(spark, manifest, "kind string, index long, c double, problem string", ["a", "b", "c"]).where("kind = 'triangle'")
    assert sorted((r["index"], r["c"]) for r in narrow.collect()) == [(k, -float(k)) for k in range(95)]
    entries = {(r["kind"], r["start"]): r for r in spark.read.json(manifest).collect()}
    broken = entries["triangle", 20]["url"].removeprefix("file:")
    with open(broken) as f:
        text = f.read()
    with open(broken, "w") as f:
        f.write(text.replace("20.5", "20.6"))
    kept = [r for k, r in entries.items() if k != ("face", 10)]
    gap = str(tmp_path / "gap")
    spark.createDataFrame(kept).coalesce(1).write.json(gap)
    bad = chunked.read_chunks(spark, gap)
    assert sorted((r["kind"], r["problem"]) for r in bad.where("problem is not null").collect()) == [("face", "starts at 20, not at 10"), ("triangle", "checksum")]
    assert bad.where("problem is null").count() == 95 - 10 + 10
    with pytest.raises(Exception, match="checksum"):
        chunked.read_chunks(spark, manifest, strict=True).collect()
    with pytest.raises(Exception, match="(?i)exist"):
        chunked.write_chunks(chunks, str(tmp_path / "mesh"))


def greedy(rows, n, stand_gap, target_gap):
    out = []
    for scene in sorted({r[0] for r in rows}):
        own, kept = sorted((r for r in rows if r[0] == scene), key=lambda r: (-r[6], r[1])), []
        for both in (True, False):
            for r in own:
                if len(kept) < n and r not in kept and all(np.hypot(r[4] - k[4], r[5] - k[5]) >= stand_gap and (not both or np.hypot(r[2] - k[2], r[3] - k[3]) >= target_gap) for k in kept):
                    kept.append(r)
        out += [(scene, r[1], k) for k, r in enumerate(kept, 1)]
    return out


@pytest.mark.parametrize(("n", "side"), [(8, 900), (8, 260), (400, 700)])
def test_hotspots_apart_equal_the_greedy_walk(spark, n, side):
    rng = np.random.default_rng(n + side)
    rows = [(f"s{k % 2}", k, *(float(x) for x in rng.uniform(0, side, 4)), float(rng.integers(0, 50))) for k in range(400)]
    df = spark.createDataFrame([*rows, ("s0", 999, 1.0, 1.0, 1.0, 1.0, None), (None, 998, 1.0, 1.0, 1.0, 1.0, 99.0), ("s1", 997, 5.0, 5.0, 5.0, 5.0, 1e9)], "scene string, id long, tx double, ty double, sx double, sy double, score double")
    got = spatial.hotspots_apart(df, n, allowed=F.col("id") != 997).collect()
    assert sorted((r["scene"], r["id"], r["rank"]) for r in got) == sorted(greedy(rows, n, 85, 90))
    if n == 8:
        assert spatial.hotspots_apart(df.limit(0)).count() == 0


def test_rings_close_and_nest(spark, tmp_path):
    """A frame with an island in its hole, cells that touch at corners, and random cells: rings to GeoJSON files and back."""
    frame = {(x, y) for x in range(7) for y in range(7)} - {(x, y) for x in range(1, 6) for y in range(1, 6)} | {(3, 3)}
    rng = np.random.default_rng(8)
    random = {(int(x) - 40, int(y) + 20) for x, y in rng.integers(0, 24, (260, 2))}
    for n, cells in enumerate((frame, {(0, 0), (1, 1), (0, 2), (-1, 1)}, random)):
        df = spark.createDataFrame([(*c, 1) for c in cells], "ix int, iy int, ring int")
        corners = raster.outline_rings(df)
        rows = corners.orderBy("ix", "ring", "k").collect()
        rings = {}
        for r in rows:
            rings.setdefault((r["ix"], r["ring"]), []).append((r["lng"], r["lat"]))
        for (_, ring), line in rings.items():
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(line, [*line[1:], line[0]], strict=True)) / 2
            assert (area > 0) == (ring == 0) and all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(line, [*line[1:], line[0]], strict=True))
        total = sum(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(line, [*line[1:], line[0]], strict=True)) / 2 for line in rings.values())
        assert total == len(cells)
        if cells is frame:
            assert sorted(len(x) for x in rings.values()) == [4, 4, 4] and len({k for k, _ in rings}) == 2
        path = str(tmp_path / f"r{n}")
        tables.write_geojson(corners.withColumns({"kind": F.lit("water"), "geom_type": F.lit("Polygon")}), path)
        back = tables.read_features(spark, path).withColumn("ix", F.monotonically_increasing_id())
        runs = raster.cells_of_rings(tables.closed_segments(tables.rings(back)))
        assert sorted((r["x"], r["row"]) for r in runs.select("row", F.explode(F.sequence("x0", "x1")).alias("x")).collect()) == sorted(cells)
    assert raster.outline_rings(df.limit(0)).count() == 0


def test_sums_do_not_depend_on_their_order(spark):
    rng = np.random.default_rng(3)
    x = [float(v) for v in rng.uniform(-1, 1, 3000) * 10.0 ** rng.integers(-6, 9, 3000)]
    got = {spark.createDataFrame([(float(v),) for v in rng.permutation(x)], "x double").repartition(n).agg(scalar.exact_sum(F.col("x"))).first()[0] for n in (1, 3, 7)}
    assert len(got) == 1 and got.pop() == pytest.approx(math.fsum(x), rel=2e-16)
    assert spark.createDataFrame([(None,)], "x double").agg(scalar.exact_sum(F.col("x"))).first()[0] is None


def test_reports_against_their_cases(spark):
    cases = spark.createDataFrame([("r", "completed", 0.1, 5.0, -1e-12, 0.5), ("r", "completed", 0.2, 7.0, 1e-13, 0.4), ("r", "failed", 0.3, None, None, None), ("q", "completed", 1.0, 1.0, 0.0, 0.1)], "run_id string, status string, wall_s double, sim_s double, mass_error double, cfl double")
    kind = "run_id string, cases int, completed int, failed int, nan_count int, negative_count int, wall_total double, wall_s double, memory double, max_cfl double, max_mass double, sim_min double, sim_max double, min_depth double, unchanged boolean"
    sound = ("r", 3, 2, 1, 0, 0, math.fsum([0.1, 0.2, 0.3]), 1.0, 9.0, 0.5, 1e-12, 5.0, 7.0, 0.2, True)
    limits = {"cases": 3, "completed_fraction": 0.6, "nan_count": 0, "negative_count": 0, "cfl": 0.95, "mass": 1e-8, "wall": 60, "memory": 100}
    failed = lambda r: {(x["run_id"], x["check"]) for x in quality.report_evaluation(cases, spark.createDataFrame([r], kind), limits).where("not ok").collect()}
    base = failed(sound)
    assert {c for r, c in base if r == "r"} == {"failed"} and len({c for r, c in base if r == "q"}) == 19  # q has no report; both kinds have a check of failed cases
    for at, name in ((1, "cases"), (2, "completed"), (3, "failed"), (6, "wall_total"), (9, "max_cfl"), (10, "max_mass"), (11, "sim_min"), (12, "sim_max")):
        off = sound[at] + 1 if isinstance(sound[at], int) else sound[at] + 1e-9
        assert ("r", name) in failed((*sound[:at], off, *sound[at + 1 :]))
    for at, value, name in ((4, 1, "nan_count"), (5, 1, "negative_count"), (7, 61.0, "wall"), (8, 101.0, "memory"), (13, -0.1, "min_depth"), (14, None, "unchanged"), (7, 0.5, "wall_covers_cases"), (13, None, "min_depth")):
        assert ("r", name) in failed((*sound[:at], value, *sound[at + 1 :]))


def test_structures_take_and_give(spark):
    rows = [(1, 2, 3.0, 3.0, 4.0, 2.0), (2, 3, -1.0, 1.0, 0.0, 2.0), (1, 3, 5.0, 0.0, 0.0, 1.0), (2, 2, 9.0, 1.0, 0.0, 1.0), (1, 2, None, 1.0, 0.0, 1.0)]
    r = {x["cell_id"]: x for x in graph.structure_sources(spark.createDataFrame(rows, "cell_a int, cell_b int, discharge double, dir_x double, dir_y double, speed double")).collect()}
    assert [r[k]["mass"] for k in (1, 2, 3)] == [-8.0, 4.0, 4.0] and [r[k]["momentum_x"] for k in (1, 2, 3)] == pytest.approx([-3.6, 1.6, 2.0]) and [r[k]["momentum_y"] for k in (1, 2, 3)] == pytest.approx([-4.8, 4.8, 0.0])
    f = lambda mode: spark.range(1).select(scalar.structure_discharge(F.lit(mode), F.lit(2.0), F.lit(1.0), F.lit(0.5), F.lit(4.0), F.lit(2.0), F.lit(3.0), F.lit(1.7), F.lit(-7.0))).first()[0]
    assert [f(m) for m in ("disabled", "fixed", "orifice", "gate", "other")] == [0.0, -7.0, pytest.approx(2 * (2 * 9.81) ** 0.5), pytest.approx(3 * (2 * 9.81) ** 0.5), None]


def test_design_rotates_categories(spark):
    d = ensemble.design_categories(spark, {"kind": ["a", "b", "c"], "none": []}, 7, 4).withColumn("case", ensemble.case_name(F.col("case_ix"))).orderBy("case_ix").collect()
    assert [(r["case"], r["value"]) for r in d] == [(f"case-{k + 1:04}", "abc"[(k + 4) % 3]) for k in range(7)]
    assert spark.range(1).select(ensemble.case_name(F.lit(123_455))).first()[0] == "case-123456"


def test_json_of_any_depth(spark):
    deep = "x"
    for k in range(30):
        deep = {"a": deep, "b": [k]} if k % 2 else [deep, None]
    got = {(r["id"], r["path"]): r["value"] for r in web.flattened(spark.createDataFrame([(1, json.dumps(deep)), (2, "no json"), (3, None), (4, "7"), (5, '{"e": {}, "f": []}')], "id int, j string"), "id", "j").collect()}

    def leaves(x, path):
        if isinstance(x, dict):
            return [y for k, v in x.items() for y in leaves(v, f"{path}.{k}")]
        if isinstance(x, list):
            return [y for k, v in enumerate(x) for y in leaves(v, f"{path}[{k}]")]
        return [(path, "null" if x is None else str(x))]

    assert got == {(1, p): v for p, v in leaves(deep, "$")} | {(4, "$"): "7"}
