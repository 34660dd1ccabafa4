"""Results on repeated keys and odd texts, and steps whose work must not outgrow their input."""

import math

import pytest
from pyspark.sql import functions as F

from meshtide.operators import graph, mesh, raster, sites, spatial, web
from meshtide.plans import views


def steps_of(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


SQUARE = [(1, 0, 0.0, 0.0, 300.0, 0.0), (1, 0, 300.0, 0.0, 300.0, 300.0), (1, 0, 300.0, 300.0, 0.0, 300.0), (1, 0, 0.0, 300.0, 0.0, 0.0)]
HOLE = [(1, 1, 100.0, 100.0, 130.0, 100.0), (1, 1, 130.0, 100.0, 130.0, 130.0), (1, 1, 130.0, 130.0, 100.0, 130.0), (1, 1, 100.0, 130.0, 100.0, 100.0)]


def test_cast_ring_stays_in_its_row(spark):
    t = spark.createDataFrame([(k, 10.0 + 29 * (k % 10), 15.0 + 31 * (k // 10)) for k in range(100)], "id long, x double, y double")
    water = spark.createDataFrame(SQUARE + HOLE, "feature int, ring int, ax double, ay double, bx double, by double")
    got_df = sites.cast_candidate_ring(t, water, 50.0, (50.0, 50.0))
    assert steps_of(got_df, "Generate") == 1  # the edges are dealt to bands, the ring is not expanded
    wet = lambda x, y: 0 <= x < 300 and 0 <= y < 300 and not (100 <= x < 130 and 100 <= y < 130)
    want = {}
    for r in t.collect():
        tries = []
        for i in range(29):
            for j, radius in enumerate(sites.RADII):
                x, y = r.x + math.cos(i * 0.22) * radius, r.y + math.sin(i * 0.22) * radius
                if not wet(x, y):
                    tries.append((abs(radius - 70.0) + 60.0 * (math.hypot(x - 50, y - 50) < 90), i * 7 + j, x, y, float(radius)))
        if tries:
            cost, _, x, y, radius = min(tries)
            want[r.id] = (x, y, radius, cost)
    got = {r.id: tuple(r)[1:] for r in got_df.collect()}
    assert got.keys() == want.keys() and 0 < len(got) < 100
    assert all(got[k] == pytest.approx(want[k]) for k in want)


REPEATED_NODES = [(1, 2.0), (1, 3.0), (2, 1.0)]


def test_rate_of_repeated_nodes(spark):
    n = spark.createDataFrame(REPEATED_NODES, "node_id long, value double")
    e = spark.createDataFrame([(9, 1, 2, 2.0)], "edge_id long, left long, right long, w double")
    cap = n.select("node_id", F.lit(4.0).alias("capacity"))
    b = spark.createDataFrame([(1, "flux", 0.0, 0.5)], "node_id long, kind string, coefficient double, value double")
    got = sorted(tuple(r) for r in graph.node_rate(e, n, cap, b).collect())
    assert got == [(1, 7.0, 0.0, 1.0, -1.75), (2, -6.0, 0.0, 0.0, 1.5)]


def test_totals_of_repeated_capacities(spark):
    rates = spark.createDataFrame([(1, 7.0, 0.0, 1.0, -1.75), (2, -6.0, 0.0, 0.0, 1.5)], "node_id long, outflow double, source double, boundary double, rate double")
    cap = spark.createDataFrame([(1, 4.0), (1, 4.0), (2, 4.0)], "node_id long, capacity double")
    assert tuple(graph.rate_totals(rates, cap).first()) == (0.0, 1.0, -1.0, 0.0)


def test_references_without_semicolon(spark):
    html = '<title>a &amp; b &amp&lt c &quotd&amp</title><a href="/x?a=1&amp;b=2&ampc=3&amp=4&amp">x</a>'
    r = web.html_resources(spark.createDataFrame([(1, "https://h.org/", html)], "page_id long, url string, html string")).first()
    assert r.title == 'a & b &< c "d&'
    assert r.links == ["https://h.org/x?a=1&b=2&ampc=3&amp=4&"]


@pytest.mark.parametrize("gap", [0, 3])
def test_merged_runs_take_one_sort(spark, gap):
    rows = [(k % 2, k * 7 % 3, k * 37 % 251, k * 37 % 251 + k * 11 % 17) for k in range(90)] + [(0, 0, 10, 10)] * 3
    df = raster.merged_runs(spark.createDataFrame(rows, "half int, row int, x0 int, x1 int"), gap, ("half", "row"))
    want = []
    for key in sorted({r[:2] for r in rows}):
        mine = []
        for x0, x1 in sorted(r[2:] for r in rows if r[:2] == key):
            if mine and x0 <= mine[-1][1] + 1 + gap:
                mine[-1][1] = max(mine[-1][1], x1)
            else:
                mine.append([x0, x1])
        want += [(*key, *m) for m in mine]
    assert sorted(tuple(r) for r in df.collect()) == want
    assert steps_of(df, "Aggregate") == 0 and df._jdf.queryExecution().sparkPlan().toString().count("Window") == 2


def test_components_join_runs_by_bucket(spark, monkeypatch):
    seen, real = [], raster.connected_components
    monkeypatch.setattr(raster, "connected_components", lambda edges, **k: seen.append(edges) or real(edges, **k))
    runs = spark.createDataFrame([(0, 0, 1000), (1, 1000, 3000), (2, 300, 310), (2, 2990, 5000), (3, -600, 299), (3, 310, 310), (5, 0, 9)], "row int, x0 int, x1 int")
    got = {(r.row, r.x0): r.component for r in raster.run_components(runs).collect()}
    first, third = got[0, 0], got[2, 300]
    assert got == {(0, 0): first, (1, 1000): first, (2, 2990): first, (2, 300): third, (3, 310): third, (3, -600): got[3, -600], (5, 0): got[5, 0]} and len(set(got.values())) == 4
    join = next(line for line in seen[0]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line)
    assert "_b" in join


RUNS = [(0, -700, -690), (0, -5, 900), (0, 1000, 1000), (1, 255, 256), (1, 511, 511), (1, 5000, 9000), (2, -256, -256)]


@pytest.mark.parametrize("rounding", ["floor", "half_even"])
def test_points_meet_runs_of_their_bucket(spark, rounding):
    runs = spark.createDataFrame(RUNS, "row int, x0 int, x1 int")
    p = [(k, x + 0.5, y + 0.5) for k, (x, y) in enumerate((x, y) for y in (-1, 0, 1, 2) for x in (-701, -700, -690, -257, -256, -255, -6, -5, 255, 256, 257, 511, 899, 900, 901, 5000, 8999, 9000, 9001))]
    got = raster.point_in_runs(spark.createDataFrame(p, "id long, px double, py double"), runs, rounding=rounding)
    snap = math.floor if rounding == "floor" else round
    assert sorted(r.id for r in got.collect()) == [k for k, x, y in p if any(row == snap(y) and x0 <= snap(x) <= x1 for row, x0, x1 in RUNS)]
    join = next(line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftSemi" in line)
    assert "_bx" in join  # dealt by columns too, not by rows alone


def test_drop_near_meets_few_pairs(spark, monkeypatch):
    seen, real = [], spatial.pairs_within
    monkeypatch.setattr(spatial, "pairs_within", lambda left, right, d: seen.append(left.count()) or real(left, right, d))
    odd = [(500, float("nan"), 1.0), (501, float("inf"), 1.0), (502, None, 1.0), (503, 1.0, float("-inf"))]
    s = [(k, k * 7 % 83 * 2.5, k * 13 % 61 * 1.5) for k in range(300)] + odd
    r = [(k, k * 5 % 23 * 3.25, k * 11 % 31 * 2.0) for k in range(300)] + [(900, 150.0, 22.0)] + odd
    kind = "id long, x double, y double"
    got = {x.id for x in spatial.drop_near(spark.createDataFrame(s, kind), spark.createDataFrame(r, kind)).collect()}
    near = lambda p, q: None not in (*p, *q) and math.dist(p, q) <= 22
    assert got == {k for k, *p in s if not any(near(p, q) for _, *q in r)}
    assert seen == [seen[0]] and seen[0] < 250  # where cells are full, no pairs are made


def test_lattice_lines_meet_their_own_region(spark):
    r = spark.createDataFrame([(k, 33.0, 130.0 + k * 0.01, 33.004, 130.004 + k * 0.01) for k in range(3)], "region long, south double, west double, north double, east double")
    e = [(k, 0, w + a, 33.0 + b, w + c, 33.0 + d) for k in range(3) for w in [130.0 + k * 0.01] for a, b, c, d in [(0.0003, 0.0001, 0.0039, 0.0001), (0.0039, 0.0001, 0.0003, 0.0037), (0.0003, 0.0037, 0.0003, 0.0001)]]
    got = sites.grid_samples(r, spark.createDataFrame(e, "feature long, ring int, ax double, ay double, bx double, by double"), 24.0, 0.001)
    want = sorted((k, i) for k in range(3) for i in range(19))
    step = 24.0 / 111320.0
    for k, row in want:
        lat, west = 33.0 + row * step, 130.0 + k * 0.01
        inside = 33.0001 < lat <= 33.0037
        n = sum(1 for c in range(40) if inside and west + 0.0003 <= west + c * step / math.cos(math.radians(lat)) < west + 0.0039 - (lat - 33.0001))
        assert got.where(f"region = {k} and row = {row}").count() == n if row in (0, 5) else True
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "region" in joins[0]
    assert got.count() > 100


def test_mesh_rows_are_not_broadcast(spark, sf):
    plan = mesh.triangle_geometry(*views.mesh(spark, sf))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def _best_by_hand(targets, stands, weight):
    want = {}
    for i, x, y, s in targets:
        pairs = [(math.hypot(x - u, y - v), k) for k, u, v in stands]
        pairs = [(-s * weight(d) if s == s else 0.0, k) for d, k in pairs if 2 <= d <= 100]
        if pairs:
            want[i] = min(pairs)[1]
    return want


def test_best_stand_scores_only_what_may_be_best(spark):
    """Of 1,600 stands around each target the weight is asked for those nearest to its best distance alone."""
    targets = [(k, 100.0 + k % 7 * 0.3, 100.0 + k // 7 * 0.3, 0.5 + k / 100) for k in range(40)]
    stands = [(k * 37 % 1600, 60.0 + k % 40 * 2.0, 60.0 + k // 40 * 2.0) for k in range(1600)]
    near = lambda d: F.when(F.abs(d - 34) > 5, F.raise_error("scored a pair that cannot be best")).otherwise(spatial.stand_weight(d))
    near.ideal = 34.0
    got = {r.target: r.stand for r in spatial.best_stand(spark.createDataFrame(targets, "id long, x double, y double, score double"), spark.createDataFrame(stands, "id long, x double, y double"), weight=near).collect()}
    assert got == _best_by_hand(targets, stands, lambda d: 0.7 + 0.3 * math.exp(-0.5 * ((d - 34) / 30) ** 2))


@pytest.mark.parametrize("parts", [1 << 20, 16])
def test_best_stand_of_any_score(spark, monkeypatch, parts):
    """Zero, negative and missing scores, stands in one place, a weight whose sides differ, and tiles dealt to many tasks."""
    monkeypatch.setattr(spatial, "PART_TARGETS", parts)
    monkeypatch.setattr(spatial, "PART_SAMPLES", parts)
    targets = [(k, k * 37 % 101 * 4.0, k * 91 % 89 * 4.0, (0.0, -0.5, float("nan"), 0.3, 1.0)[k % 5]) for k in range(150)] + [(900, 5000.0, 5000.0, 1.0), (901, 0.0, 0.0, 1.0), (902, None, 0.0, 1.0)]
    stands = [(k * 17 % 241, k * 53 % 97 * 5.0, k * 29 % 83 * 5.0) for k in range(120)] + [(1000 + k, 34.0, 0.0) for k in range(5)] + [(-1, None, 3.0), (-2, float("nan"), 3.0)]
    t, s = spark.createDataFrame([*targets, (903, 0.0, 0.0, None)], "id long, x double, y double, score double"), spark.createDataFrame(stands, "id long, x double, y double")
    got = {r.target: r.stand for r in spatial.best_stand(t, s, weight=sites.near_stand_weight).collect()}
    weight = lambda d: (0.66 + 0.34 * math.exp(-0.5 * ((d - 34) / 30) ** 2)) * (0.55 if d < 5 else 1.0)
    assert got == _best_by_hand([r for r in targets if r[0] not in (900, 902)], [r for r in stands if r[0] >= 0], weight)
    assert got[901] == 1000 and 900 not in got
    assert spatial.best_stand(t.limit(0), s).count() == 0 and spatial.best_stand(t, s.limit(0)).count() == 0


class _State:
    """A value and list state that counts what is asked of it."""

    def __init__(self):
        self.rows, self.calls, self.most = [], 0, 0

    def _call(self, rows):
        self.calls, self.rows = self.calls + 1, rows
        self.most = max(self.most, len(rows))

    exists = lambda self: (self._call(self.rows), bool(self.rows))[1]
    appendValue = lambda self, row: self._call([*self.rows, row])
    appendList = lambda self, rows: self._call([*self.rows, *rows])
    put = lambda self, rows: self._call(list(rows))
    update = lambda self, row: self._call([row])
    clear = lambda self: self._call([])


def test_held_rows_travel_in_chunks():
    """A cell's rows are held as a chunk for each batch, and a cell costs few calls to the state."""
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    from meshtide.streaming import stateful

    class Value(_State):
        get = lambda self: (self._call(self.rows), self.rows[0] if self.rows else None)[1]

    class Many(_State):
        get = lambda self: (self._call(self.rows), iter(self.rows))[1]

    values, lists, timers = [], [], []
    handle = SimpleNamespace(getValueState=lambda *_: values.append(Value()) or values[-1], getListState=lambda *_: lists.append(Many()) or lists[-1], registerTimer=timers.append, deleteTimer=timers.remove)
    p = stateful._hysteresis(0.6, 0.2)
    p.init(handle)
    rng = np.random.default_rng(1)
    us, h = rng.permutation(1000) // 3 * 1_000_000, np.round(rng.random(1000), 1)
    for part in (slice(0, 400), slice(400, 1000)):
        list(p.handleInputRows((7,), iter([pd.DataFrame({"us": us[part], "h": h[part]})]), None))
    assert lists[0].most == 2 and timers == [1]
    got = []
    for upto in (100_000, 10**9):
        timers.clear()
        got += [tuple(r) for f in p.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda upto=upto: upto), None) for r in f.itertuples(index=False)]
        assert timers == ([101_001] if upto == 100_000 else [])
    want, flag = [], None
    for t, x in sorted(zip(us.tolist(), h.tolist(), strict=True)):
        now = 1 if x >= 0.6 else 0 if x <= 0.2 or flag is None else flag
        want.append((7, t, now, None if flag is None or now == flag else "wetting" if now else "drying"))
        flag = now
    assert got == want and sum(s.calls for s in values + lists) <= 14
