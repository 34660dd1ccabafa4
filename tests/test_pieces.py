"""Long groups in pieces give the rows of whole ones."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshtide.operators import ensemble, pieces, series


@pytest.fixture(scope="module")
def readings(spark):
    """One series holds most rows; it and the rows without a series have times apart, null times and few decisive values."""
    rng = np.random.default_rng(7)
    keys = [1.0] * 600 + [2.0] * 40 + [None] * 200
    steps = [None, *range(599), *range(40), None, *range(0, 1990, 10)]
    rows = [(k, t, float(h)) for k, t, h in zip(keys, steps, rng.choice([0.0, 6e-4, 7e-4, 8e-4, 2e-3], len(keys), p=[0.03, 0.3, 0.32, 0.32, 0.03]), strict=True)]
    return spark.createDataFrame(rows, "cell double, step long, h double").repartition(3).persist()


def as_rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_pieces_are_small_and_ordered(readings):
    parts = pieces.cut(readings, "cell", "step", 100)
    sizes = {(r["cell"], r["_piece"]): (r["n"], r["a"], r["b"]) for r in parts.groupBy("cell", "_piece").agg(F.count(F.lit(1)).alias("n"), F.min("step").alias("a"), F.max("step").alias("b")).collect()}
    assert max(n for n, _, _ in sizes.values()) <= 110 and sizes[2.0, 0][0] == 40 and sizes[1.0, -1][0] == 1
    along = [sizes[k] for k in sorted(k for k in sizes if k[0] == 1.0 and k[1] >= 0)]
    assert len(along) > 5 and all(p[2] < q[1] for p, q in zip(along, along[1:], strict=False))
    assert pieces.cut(readings, "cell", "step", 1000) is None and pieces.cut(readings.limit(0), "cell", "step", 1) is None
    assert pieces.cut(readings.withColumn("step", F.col("step").cast("string")), "cell", "step", 1) is None


def test_hysteresis_in_pieces(readings):
    whole, cut = (as_rows(series.hysteresis(readings, group_rows=n), "cell", "step") for n in (10**6, 50))
    assert whole == cut and len(cut) == 840
    state, want = 0, []
    for _, _, h in sorted((r[:3] for r in cut if r[0] == 1.0), key=lambda r: -1 if r[1] is None else r[1]):
        state = 1 if h >= 1e-3 else 0 if h <= 5e-4 else state
        want.append(state)
    assert [r[3] for r in cut if r[0] == 1.0] == want and 0 < sum(want) < len(want)


def test_equal_orders_share_a_piece(spark):
    same = spark.createDataFrame([(1, 5, 2e-3)] * 30, "cell int, step int, h double")
    assert {(r["wet"], r["newly_dry"]) for r in series.hysteresis(same, group_rows=4).collect()} == {(1, False)}


def test_interpolation_in_pieces(readings, spark):
    s = readings.select(F.col("cell").alias("series_id"), F.col("step").cast("double").alias("t"), F.col("h").alias("value")).where("t % 7 = 0 or series_id is null")
    q = spark.createDataFrame([(k, t / 4) for k in (1.0, 2.0, None, 3.0) for t in range(-40, 2600, 13)], "series_id double, t double")
    for how in ("hold", "error"):
        whole, cut = (as_rows(series.interpolate_at(s, q, how, n), "series_id", "t") for n in (10**6, 40))
        assert whole == cut and len(cut) == q.count()
    one = sorted((r["t"], r["value"]) for r in s.where("series_id = 1 and t is not null").collect())
    got = {r[1]: r[2] for r in as_rows(series.interpolate_at(s, q, "hold", 40), "series_id", "t") if r[0] == 1.0}
    assert all(math.isclose(got[t], np.interp(t, *zip(*one, strict=True)), abs_tol=1e-15) for t in got)


def test_order_violations_in_pieces(readings):
    s = readings.select(F.col("cell").alias("series_id"), F.col("step").alias("ordinal"), F.when(F.col("step") % 41 != 7, F.col("step") - F.when(F.col("step") % 50 == 0, 3).otherwise(0)).alias("t"))
    whole, cut = (as_rows(series.order_violations(s, group_rows=n), "series_id") for n in (10**6, 30))
    assert whole == cut and cut[1][2] > 10


def test_percentiles_of_long_groups(spark):
    rng = np.random.default_rng(3)
    data = pd.concat([pd.DataFrame({"cell": 1.0, "v": rng.normal(size=3000)}), pd.DataFrame({"cell": 2.0, "v": rng.integers(0, 3, 2000) * 1.0}), pd.DataFrame({"cell": 3.0, "v": [4.5]}), pd.DataFrame({"cell": np.nan, "v": rng.normal(size=500).round(1)})])
    df = spark.createDataFrame(data).select(F.when(~F.isnan("cell"), F.col("cell")).alias("cell"), "v").union(spark.createDataFrame([(1.0, None), (9.0, None)], "cell double, v double"))
    for limit in (10**6, 64):
        got = {r["cell"]: r["p"] for r in pieces.grouped_percentiles(df, "cell", ensemble.PROBABILITIES, limit).collect()}
        assert set(got) == {1.0, 2.0, 3.0, None}
        for k, p in got.items():
            want = np.quantile(data[data.cell.isna() if k is None else data.cell == k].v, ensemble.PROBABILITIES)
            assert np.allclose(p, want, rtol=0, atol=1e-14)


def test_cell_statistics_of_long_cells(spark):
    rng = np.random.default_rng(5)
    f = pd.DataFrame({"case_id": range(900), "cell_id": [0] * 700 + [1] * 150 + [2] * 50, "depth": rng.random(900).round(2), "u": rng.normal(size=900), "v": rng.normal(size=900)})
    df = spark.createDataFrame(f)
    whole, cut = (df2.toPandas() for df2 in (ensemble.cell_statistics(df).orderBy("cell_id"), ensemble.cell_statistics(df, group_rows=100).orderBy("cell_id")))
    pd.testing.assert_frame_equal(whole, cut, rtol=1e-12)
