"""Nearest search by descent of boxes against brute force."""

import contextlib
import io
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshtide.operators import nearest, sites, spatial


def crowd(rng, n):
    """Most things in one small place, some far away, some in the same spot."""
    p = np.concatenate([rng.normal(0, 0.01, (n, 2)), rng.uniform(-1000, 1000, (n // 4, 2))])
    p[: n // 3] = p[0]
    return p


@pytest.mark.parametrize("leaf", [3, 10_000])
def test_nearest_axis(spark, leaf):
    rng = np.random.default_rng(1)
    v = crowd(rng, 60)
    lines = pd.DataFrame({"line_id": np.arange(len(v)) // 8, "ix": np.arange(len(v)) % 8, "x": v[:, 0], "y": v[:, 1]})
    measured = spatial.polyline_measure(spark.createDataFrame(lines)).persist()
    points = pd.DataFrame({"id": range(130), "x": crowd(rng, 104)[:, 0], "y": crowd(rng, 104)[:, 1]})
    got = {r["id"]: r for r in spatial.nearest_axis(spark.createDataFrame(points).union(spark.createDataFrame([(500, None, 1.0)], "id int, x double, y double")), measured, leaf).collect()}
    assert set(got) == set(points.id)
    segments = measured.toPandas().sort_values(["line_id", "ix"])
    for r in points.itertuples():
        n = (segments.bx - segments.ax) ** 2 + (segments.by - segments.ay) ** 2
        t = (((r.x - segments.ax) * (segments.bx - segments.ax) + (r.y - segments.ay) * (segments.by - segments.ay)) / n.where(n > 0, 1)).clip(0, 1).where(n > 0, 0)
        d = np.hypot(r.x - segments.ax - t * (segments.bx - segments.ax), r.y - segments.ay - t * (segments.by - segments.ay))
        assert math.isclose(got[r.id]["d"], d.min(), rel_tol=1e-12, abs_tol=1e-12)
        at = segments[d <= d.min() + 1e-13].iloc[0]
        assert (got[r.id]["line_id"], got[r.id]["ix"]) == (at.line_id, at.ix)


@pytest.mark.parametrize("leaf", [2, 10_000])
def test_nearest_boundary_over_the_globe(spark, leaf):
    rng = np.random.default_rng(2)
    b = pd.DataFrame({"id": range(150), "lat": np.r_[rng.uniform(-90, 90, 75), rng.normal(35, 0.01, 75)], "lng": np.r_[rng.uniform(-180, 180, 75), rng.normal(-179.9, 0.01, 75)]})
    b = pd.concat([b, b.iloc[:5].assign(id=range(900, 905))])
    p = pd.DataFrame({"id": range(120), "lat": np.r_[rng.uniform(-90, 90, 80), rng.normal(35, 0.02, 40)], "lng": np.r_[rng.uniform(-180, 180, 80), rng.normal(179.9, 0.02, 40)]})
    got = {r["id"]: r for r in spatial.nearest_boundary(spark.createDataFrame(p), spark.createDataFrame(b), leaf=leaf).collect()}
    every = spatial.boundary_distances(spark.createDataFrame(p), spark.createDataFrame(b)).toPandas()
    assert len(every) == len(p) * len(b)
    for k, rows in every.groupby("id"):
        first = rows.sort_values(["d", "b_id"]).iloc[0]
        assert (got[k]["nearest"], got[k]["d"]) == (first.b_id, first.d)


@pytest.mark.parametrize("leaf", [3, 10_000])
def test_opposite_cells(spark, leaf):
    rng = np.random.default_rng(3)
    c = crowd(rng, 120)
    cells = pd.DataFrame({"cell_id": range(len(c)), "x": c[:, 0], "y": c[:, 1], "component": np.arange(len(c)) % 3})
    s = pd.DataFrame({"id": range(50), "x": crowd(rng, 40)[:, 0], "y": crowd(rng, 40)[:, 1], "bearing": rng.uniform(0, 360, 50), "up": [0, 1] * 25, "down": [2, 7] * 25})
    got = {r["id"]: (r["behind"], r["ahead"]) for r in sites.opposite_side_pair(spark.createDataFrame(s), spark.createDataFrame(cells), leaf=leaf).collect()}
    for r in s.itertuples():
        dx, dy, at = cells.x - r.x, cells.y - r.y, math.radians(r.bearing)
        along, d = dx * math.sin(at) - dy * math.cos(at), np.sqrt(dx * dx + dy * dy)
        error = ((np.degrees(np.arctan2(dx, -dy)) - r.bearing + 180) % 360 - 180).abs()
        behind, ahead = d[(along < 0) & (cells.component == r.up)], (d + 0.15 * error)[(along > 0) & (cells.component == r.down)]
        want = tuple(None if x.empty else int(x.index[np.lexsort((x.index, x))[0]]) for x in (behind, ahead))
        assert got[r.id] == want


def test_a_crowded_place_is_split_and_nothing_meets_all(spark):
    rng = np.random.default_rng(4)
    p = crowd(rng, 400)
    things = spark.createDataFrame(pd.DataFrame({"k": range(len(p)), "x": p[:, 0], "y": p[:, 1]})).dropDuplicates(["x", "y"])
    things = things.select("k", "x", "y", F.lit(0).alias("part"), *[F.col(c).alias(b) for b, c in zip(nearest.BOX, "xyxy", strict=True)])
    levels, leaves = nearest.box_tree(things, ["k"], 8)
    assert len(levels) > 8 and leaves.count() == things.count() and leaves.groupBy("depth", "node").count().agg(F.max("count")).first()[0] <= 8
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        b = spark.createDataFrame(pd.DataFrame({"id": range(300), "lat": rng.uniform(-60, 60, 300), "lng": rng.uniform(-170, 170, 300)}))
        spatial.nearest_boundary(b, b, leaf=4).explain()
    assert "CartesianProduct" not in text.getvalue() and "NestedLoop" not in text.getvalue()


def test_nothing_to_find(spark):
    p = spark.createDataFrame([(1, 1.0, 2.0)], "id int, lat double, lng double")
    assert spatial.nearest_boundary(p, p.limit(0)).count() == 0 and spatial.nearest_boundary(p.limit(0), p).count() == 0
    assert tuple(spatial.nearest_boundary(p, p).first()) == (1, 1, 0.0)


def test_deep_levels_are_broadcast_and_leaves_meet_points_whole(spark):
    """65,536 boxes in one level still meet the points where they are; of each box a point takes its best thing on, not a row for each."""
    k = F.col("k")
    things = spark.range(1 << 16).withColumnRenamed("id", "k").withColumns({"x": (k % 256).cast("double"), "y": F.floor(k / 256).cast("double")})
    things = things.select("k", "x", "y", F.lit(0).alias("part"), *[F.col(c).alias(b) for b, c in zip(nearest.BOX, "xyxy", strict=True)])
    points = spark.createDataFrame([(j, 0, j * 7.31 % 255, j * 11.93 % 255) for j in range(40)], "id long, part int, px double, py double")
    apart = lambda c: F.hypot(F.col("px") - c("x"), F.col("py") - c("y"))
    levels, _ = nearest.box_tree(things, ["k"], 1)
    assert levels[-1].count() > 50_000 and all("broadcast" in level._jdf.queryExecution().logical().toString() for level in levels)
    found = nearest.nearest(points, things, apart, nearest.box_gap(F.col("px"), F.col("py")), ["k"], leaf=1)
    assert {r["id"]: r["found"]["k"] for r in found.collect()} == {r.id: round(r.px) + 256 * round(r.py) for r in points.collect()}
