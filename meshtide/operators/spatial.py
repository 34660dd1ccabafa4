"""Spatial joins and hotspot selection in local metres; large sides meet in grid buckets, never pair by pair."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtide.functions.geo import haversine, segment_distance, segments_cross
from meshtide.operators.nearest import BOX, LEAF, box_gap, nearest
from meshtide.session import settled


def bucketed(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn("gx", F.floor(F.col(x) / size)).withColumn("gy", F.floor(F.col(y) / size))


def spread(df: DataFrame, reach: int = 1) -> DataFrame:
    """A row for its own bucket and each one within ``reach``."""
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])
    return df.withColumn("o", F.explode(offsets)).withColumn("gx", F.col("gx") + F.col("o.a")).withColumn("gy", F.col("gy") + F.col("o.b")).drop("o")


def pairs_within(left: DataFrame, right: DataFrame, distance: float) -> DataFrame:
    """``id, other, d`` of points (id, x, y) at most ``distance`` apart."""
    a = spread(bucketed(left.select("id", "x", "y"), distance))
    b = bucketed(right.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy")), distance, "ox", "oy")
    d = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))
    return a.join(b, ["gx", "gy"]).select("id", "other", d.alias("d")).where(F.col("d") <= distance)


def point_in_polygon(points: DataFrame, edges: DataFrame, band: float) -> DataFrame:
    """``id, feature`` for points inside polygons, by the even-odd rule.

    ``points(id, x, y)``, ``edges(feature, ring, ax, ay, bx, by)`` with ring 0 the
    outside and others holes. Edges are dealt to horizontal bands of height
    ``band``; a point counts the edges of its own band that it sees to its left.
    """
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    e = edges.where("ay <> by").withColumn("g", F.explode(F.sequence(F.floor(low / band), F.floor(high / band))))
    p = points.select("id", "x", "y", F.floor(F.col("y") / band).alias("g"))
    crosses = ((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & (F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax"))
    n = p.join(e, "g").where(crosses).groupBy("id", "feature", "ring").count()
    odd = n.where("count % 2 = 1").groupBy("id", "feature").agg(F.max((F.col("ring") == 0).cast("int")).alias("outer"), F.max((F.col("ring") > 0).cast("int")).alias("hole"))
    return odd.where("outer = 1 and hole = 0").select("id", "feature")


def blocked_points(points: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Ids of points within ``buffer`` of a segment (or point, where both ends are equal) of ``exclusions(ax, ay, bx, by, buffer)``.

    The exclusions of a scene are few rules; Spark broadcasts them while they are small and loops over both sides otherwise.
    """
    d, _ = segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return points.join(exclusions.select("ax", "ay", "bx", "by", "buffer"), d <= F.col("buffer"), "left_semi").select("id")


def path_conflict(lines: DataFrame) -> tuple[DataFrame, Column]:
    """``lines`` reduced to what a path (px, py, qx, qy) is tested against, and the test."""
    names = ("px", "py", "qx", "qy", "ax", "ay", "bx", "by")
    px, py, qx, qy, ax, ay, bx, by = (F.col(c) for c in names)
    hit, columns = segments_cross(px, py, qx, qy, ax, ay, bx, by), list(names[4:])
    if "buffer" in lines.columns:
        columns.append("buffer")
        apart = F.least(segment_distance(px, py, ax, ay, bx, by)[0], segment_distance(qx, qy, ax, ay, bx, by)[0], segment_distance(ax, ay, px, py, qx, qy)[0], segment_distance(bx, by, px, py, qx, qy)[0])
        hit = hit | F.coalesce(apart <= F.col("buffer"), F.lit(False))
    return lines.select(*columns), hit


def blocked_paths(paths: DataFrame, lines: DataFrame) -> DataFrame:
    """``paths`` (with px, py, qx, qy) that cross a segment of ``lines(ax, ay, bx, by[, buffer])`` or come within its ``buffer``; null or no buffer: crossing only."""
    return paths.join(*path_conflict(lines), "left_semi")


def prefers(ideal: float):
    """Marks a weight that rises up to the distance ``ideal`` and falls beyond it, so that :func:`best_stand` needs no other pairs.

    On either side it changes by more than a score's rounding where the square of the difference to
    ``ideal`` is greater by :data:`SLACK`; the two sides need not be alike.
    """

    def mark(weight: Callable[[Column], Column]) -> Callable[[Column], Column]:
        weight.ideal = ideal
        return weight

    return mark


@prefers(34.0)
def stand_weight(d: Column) -> Column:
    return 0.70 + 0.30 * F.exp(-0.5 * F.pow((d - 34) / 30, 2))


#: Squares of differences to the ideal distance that are nearer than this are told apart by the score alone.
SLACK = 1e-8
#: Targets of a tile on average and at most, samples at most that one task takes up at once.
TILE_TARGETS, PART_TARGETS, PART_SAMPLES = 1 << 12, 1 << 15, 1 << 20
#: Rows of the largest arrays in :func:`_on_ring`, and tiles that are broadcast.
ARRAY_ROWS, BROADCAST_TILES = 1 << 20, 50_000


def _ranges(start, count):
    """Numbers from each ``start`` on, ``count`` of each, and which start they came from."""
    import numpy as np

    owner = np.repeat(np.arange(len(start)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner]


def _on_ring(px, py, qx, qy, ideal: float, least: float, reach: float):
    """Pairs (target, sample) of positions: the samples of each target ``least`` to ``reach`` away whose distance is nearest to ``ideal`` from below and from above, within SLACK.

    Samples lie in strips of as many each, by y within a strip. A few places on the ring give first
    bounds; of each strip only the samples between the two circles of these bounds are then looked at.
    """
    import numpy as np

    strips = max(1, math.isqrt(len(qx)) // 2)
    strip = np.empty(len(qx), int)
    strip[np.argsort(qx, kind="stable")] = np.arange(len(qx)) * strips // len(qx)
    bottom, height = qy.min() - 2, float(np.ptp(qy)) + 4
    order = np.lexsort((qy, strip))
    qx, qy, strip = qx[order], qy[order], strip[order]
    key = strip * height + (qy - bottom)
    at = lambda k, y, side: np.searchsorted(key, k * height + np.clip(y - bottom, 0, height - 1e-9), side)
    first = np.searchsorted(strip, np.arange(strips))
    x0, x1 = np.minimum.reduceat(qx, first), np.maximum.reduceat(qx, first)
    eps = 1e-9 * reach + 8 * float(np.spacing(key[-1] + height))

    def misfit(t, q):
        dx, dy = px[t] - qx[q], py[t] - qy[q]
        d = np.sqrt(dx * dx + dy * dy)
        return np.where((d >= least) & (d <= reach), np.abs(d - ideal), np.inf), (d > ideal).astype(int)

    below, above, every = np.full(len(px), ideal - least), np.full(len(px), reach - ideal), np.arange(len(px))
    for turn in np.arange(16) * math.pi / 8:
        x, y = px + min(reach, max(least, ideal)) * math.cos(turn), py + min(reach, max(least, ideal)) * math.sin(turn)
        q = at(np.maximum(0, np.searchsorted(x0, x, "right") - 1), y, "left")
        for near in (q - 1, q):
            m, beyond = misfit(every, np.clip(near, 0, len(qx) - 1))
            below, above = np.where(beyond, below, np.minimum(below, m)), np.where(beyond, np.minimum(above, m), above)
    outer, inner = np.minimum(reach, ideal + np.maximum(0, above)) + eps, np.maximum(0, np.maximum(least, ideal - np.maximum(0, below)) - eps)
    left, right = np.searchsorted(x1, px - outer), np.searchsorted(x0, px + outer, "right")
    found = [(every[:0], order[:0])]
    for some in np.split(every, np.searchsorted(np.cumsum(np.maximum(0, right - left)), np.arange(ARRAY_ROWS // 4, int(np.maximum(0, right - left).sum()), ARRAY_ROWS // 4))):
        if not len(some):
            continue
        t, k = _ranges(left[some], np.maximum(0, right - left)[some])
        t = some[t]
        dx0, dx1 = np.maximum(0, np.maximum(x0[k] - px[t], px[t] - x1[k])), np.maximum(np.abs(px[t] - x0[k]), np.abs(px[t] - x1[k]))
        far, near = np.sqrt(np.maximum(0, outer[t] ** 2 - dx0**2)) + eps, np.sqrt(np.maximum(0, inner[t] ** 2 - dx1**2)) - eps
        a0, a1, b0, b1 = at(k, py[t] - far, "left"), at(k, py[t] - near, "right"), at(k, py[t] + near, "left"), at(k, py[t] + far, "right")
        start, end = np.stack((a0, np.maximum(a1, b0)), 1).ravel(), np.stack((a1, b1), 1).ravel()
        t, count = np.repeat(t, 2), np.maximum(0, end - start)
        # a target of many samples is looked through piece by piece
        cuts = np.searchsorted(np.cumsum(count), np.arange(ARRAY_ROWS, int(count.sum()), ARRAY_ROWS))
        best, rows = np.full(2 * len(some), np.inf), []
        for part in np.split(np.arange(len(t)), cuts):
            o, q = _ranges(start[part], count[part])
            u = t[part][o]
            m, beyond = misfit(u, q)
            place = 2 * (u - some[0]) + beyond
            np.minimum.at(best, place, m)
            ok = np.isfinite(m) & (m**2 <= best[place] ** 2 + SLACK)
            rows.append((u[ok], q[ok], m[ok], place[ok]))
        u, q, m, place = (np.concatenate(c) for c in zip(*rows, strict=True))
        ok = m**2 <= best[place] ** 2 + SLACK
        found.append((u[ok], order[q[ok]]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _first_in_reach(px, py, qx, qy, least: float, reach: float):
    """Pairs (target, sample) of positions: the first sample that is ``least`` to ``reach`` away from each target."""
    import numpy as np

    rest, start, found = np.arange(len(px)), 0, []
    while len(rest) and start < len(qx):
        end = start + max(1, ARRAY_ROWS // len(rest))
        dx, dy = px[rest, None] - qx[None, start:end], py[rest, None] - qy[None, start:end]
        d = np.sqrt(dx * dx + dy * dy)
        hit = (d >= least) & (d <= reach)
        some = hit.any(axis=1)
        found.append((rest[some], start + hit[some].argmax(axis=1)))
        rest, start = rest[~some], end
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (rest[:0], rest[:0])


def _likely_stands(targets: DataFrame, samples: DataFrame, reach: float, least: float, ideal: float) -> DataFrame:
    """Pairs of ``targets(id, px, py, s)`` and ``samples(other, qx, qy)`` that hold the best of each target.

    A tile's targets meet the samples within reach of the tile in a task of their own; a crowded tile is
    dealt to several, each with a part of the targets and a part of the samples. Of a target with a positive
    score only the samples nearest to ``ideal`` remain; where all score alike (zero, infinite, not a number), the first.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    n, x0, y0, x1, y1 = targets.agg(F.count(F.lit(1)), F.min("px"), F.min("py"), F.max("px"), F.max("py")).first()
    side = max(reach, math.sqrt(max(x1 - x0, reach) * max(y1 - y0, reach) * TILE_TARGETS / n)) if n else reach
    t = bucketed(targets, side, "px", "py")
    # a place is as good as another one there, and the smaller id wins
    q = bucketed(samples.groupBy("qx", "qy").agg(F.min("other").alias("other")), side, "qx", "qy").withColumnsRenamed({"gx": "hx", "gy": "hy"})
    parts = lambda df, name, most: df.agg(F.ceil(F.sum("n") / most).cast("int").alias(name))
    held = spread(q.groupBy(F.col("hx").alias("gx"), F.col("hy").alias("gy")).agg(F.count(F.lit(1)).alias("n")))
    tiles = parts(t.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n")).groupBy("gx", "gy"), "a_parts", PART_TARGETS).join(parts(held.groupBy("gx", "gy"), "b_parts", PART_SAMPLES), ["gx", "gy"])
    tiles = settled(tiles)
    small = F.broadcast if tiles.count() <= BROADCAST_TILES else (lambda df: df)
    around = spread(tiles.select(F.col("gx").alias("tx"), F.col("gy").alias("ty"), "gx", "gy", "a_parts", "b_parts")).withColumnsRenamed({"gx": "hx", "gy": "hy"})
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    t = t.join(small(tiles), ["gx", "gy"]).withColumn("a", deal("id", "a_parts")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("b_parts") - 1))).drop("a_parts", "b_parts")
    edge = reach * (1 + 1e-9)
    inside = lambda c, g: F.col(c).between(F.col(g) * side - edge - F.abs(F.col(c)) * 1e-12, (F.col(g) + 1) * side + edge + F.abs(F.col(c)) * 1e-12)
    q = q.join(small(around), ["hx", "hy"]).where(inside("qx", "tx") & inside("qy", "ty")).withColumn("b", deal("other", "b_parts")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("a_parts") - 1)))
    q = q.select(F.col("tx").alias("gx"), F.col("ty").alias("gy"), "a", "b", "other", "qx", "qy")

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        left, right = left.select(["id", "px", "py", "s"]), right.select(["other", "qx", "qy"])
        if not len(left) or not len(right):
            return pa.table([*left.slice(0, 0).columns, *right.slice(0, 0).columns], names=[*left.column_names, *right.column_names])
        px, py, s = (left[c].to_numpy() for c in ("px", "py", "s"))
        alike = ~((s > 1e-290) & (s < np.inf))
        pairs = []
        for which in (False, True):
            mine = np.flatnonzero(alike == which)
            if len(mine):
                chosen = right.take(pc.sort_indices(right["other"])) if which else right
                qx, qy = chosen["qx"].to_numpy(), chosen["qy"].to_numpy()
                mine = mine[np.lexsort((py[mine], np.floor(px[mine])))]  # neighbours look into the same strips
                i, j = _first_in_reach(px[mine], py[mine], qx, qy, least, reach) if which else _on_ring(px[mine], py[mine], qx, qy, ideal, least, reach)
                out = left.take(pa.array(mine[i]))
                for c in chosen.column_names:
                    out = out.append_column(c, chosen[c].take(pa.array(j)))
                pairs.append(out)
        return pa.concat_tables(pairs)

    kind = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, names in ((targets, ("id", "px", "py", "s")), (samples, ("other", "qx", "qy"))) for c in names)
    keys = ("gx", "gy", "a", "b")
    return t.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(pick, kind)


def best_stand(targets: DataFrame, samples: DataFrame, reach: float = 100.0, least: float = 2.0, weight=stand_weight, blocked_by: DataFrame | None = None) -> DataFrame:
    """``target, stand, d, score``: for each ``targets(id, x, y, score)`` the sample with the best weighted score; the smaller sample id wins ties.

    With a weight that :func:`prefers` a distance, only the samples nearest to that distance are
    scored. Other weights, negative scores and blocked paths need all pairs within reach; these meet in grid buckets
    and are reduced where they arise, so that only the best of each task and target is shuffled.
    """
    t = targets.select("id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"), F.col("score").cast("double").alias("s")).where("s is not null")
    q = samples.select(F.col("id").alias("other"), F.col("x").cast("double").alias("qx"), F.col("y").cast("double").alias("qy"))
    d = F.sqrt(F.pow(F.col("px") - F.col("qx"), 2) + F.pow(F.col("py") - F.col("qy"), 2))
    ideal = getattr(weight, "ideal", None)
    every = ideal is None or blocked_by is not None
    all_of = t if every else t.where(f"s < 0 and s > double('-inf')")
    p = spread(bucketed(all_of, reach, "px", "py")).join(bucketed(q, reach, "qx", "qy"), ["gx", "gy"]).drop("gx", "gy")
    if not every:
        finite = lambda df, *c: df.where(" and ".join(f"abs({k}) < double('inf')" for k in c))
        likely = _likely_stands(finite(t.where("s >= 0 or s = double('-inf')"), "px", "py"), finite(q, "qx", "qy").where("other is not null"), reach, least, ideal)
        p = likely.unionByName(p.select(*likely.columns)) if not all_of.isEmpty() else likely
    p = p.withColumn("d", d).where(F.col("d").between(least, reach))
    if blocked_by is not None:
        p = p.join(*path_conflict(blocked_by), "left_anti")
    best = p.groupBy("id").agg(F.min(F.struct((-F.col("s") * weight(F.col("d"))).alias("k"), "other", "d")).alias("b"))
    return best.select(F.col("id").alias("target"), F.col("b.other").alias("stand"), "b.d", (-F.col("b.k")).alias("score"))


def polyline_measure(vertices: DataFrame) -> DataFrame:
    """Segments of ``vertices(line_id, ix, x, y)`` with their start along the line and the line's total length."""
    w = W.partitionBy("line_id").orderBy("ix")
    s = vertices.select("line_id", "ix", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx is not null")
    s = s.withColumn("length", F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2)))
    return s.withColumn("start", F.coalesce(F.sum("length").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).withColumn("total", F.sum("length").over(W.partitionBy("line_id")))


def nearest_axis(points: DataFrame, measured: DataFrame, leaf: int = LEAF) -> DataFrame:
    """``id, line_id, ix, d, offset, progress, tx, ty, nx, ny``: nearest segment of the measured polylines with its tangent and left normal; offset is positive to its left.

    Ties go to the smaller line, then segment; points without coordinates have no row.
    Points of the same place are looked up once, and of equal segments the first is taken.
    """
    at = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    segments = measured.groupBy("ax", "ay", "bx", "by").agg(F.min(F.struct("line_id", "ix", "length", "start", "total")).alias("s")).select("ax", "ay", "bx", "by", "s.*")
    segments = segments.select("*", F.lit(0).alias("part"), F.least("ax", "bx").alias(BOX[0]), F.least("ay", "by").alias(BOX[1]), F.greatest("ax", "bx").alias(BOX[2]), F.greatest("ay", "by").alias(BOX[3]))
    places = at.select(F.lit(0).alias("part"), "x", "y").distinct()
    x, y = F.col("x"), F.col("y")
    n = nearest(places, segments, lambda c: segment_distance(x, y, c("ax"), c("ay"), c("bx"), c("by"))[0], box_gap(x, y), ["line_id", "ix"], leaf=leaf)
    n = at.select("id", "x", "y").join(n.select("x", "y", F.col("cost").alias("d"), "found.*"), ["x", "y"])
    _, t = segment_distance(x, y, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    side = F.signum((F.col("bx") - F.col("ax")) * (y - F.col("ay")) - (F.col("by") - F.col("ay")) * (x - F.col("ax")))
    tx, ty = F.try_divide(F.col("bx") - F.col("ax"), F.col("length")), F.try_divide(F.col("by") - F.col("ay"), F.col("length"))
    return n.select("id", "line_id", "ix", "d", (side * F.col("d")).alias("offset"), F.try_divide(F.col("start") + t * F.col("length"), F.col("total")).alias("progress"), tx.alias("tx"), ty.alias("ty"), (-ty).alias("nx"), tx.alias("ny"))


def sphere_gap(lat: Column, lng: Column, radius: float) -> Callable[[Column, Column, Column, Column], Column]:
    """A lower bound of the great-circle distance of a point to a box (x is the longitude, in -180..180), for :func:`nearest`."""
    around = lambda v: F.abs(F.pmod(v + 180, F.lit(360.0)) - 180)

    def gap(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        north = F.radians(F.greatest(y0 - lat, lat - y1, F.lit(0.0)))
        turn = F.when((lng >= x0) & (lng <= x1), 0.0).otherwise(F.radians(F.least(around(x0 - lng), around(x1 - lng))))
        to_meridian = F.asin(F.least(F.lit(1.0), F.cos(F.radians(lat)) * F.sin(turn)))
        to_pole = math.pi / 2 - F.radians(F.abs(lat))
        return radius * F.greatest(north, F.when(turn < math.pi / 2, to_meridian).otherwise(to_pole)) * (1 - 1e-9)

    return gap


def nearest_boundary(stations: DataFrame, boundary: DataFrame, radius: float = 6371008.8, leaf: int = LEAF) -> DataFrame:
    """``id, nearest, d`` for ``(id, lat, lng)`` stations and boundary points; ties go to the smaller boundary id.

    Longitudes lie in -180..180. Stations with an id of their own each; without coordinates they have no row.
    """
    at = stations.where("lat is not null and lng is not null")
    points = boundary.where("lat is not null and lng is not null").groupBy(F.col("lat").cast("double").alias("b_lat"), F.col("lng").cast("double").alias("b_lng")).agg(F.min("id").alias("b_id"))
    things = points.select("*", F.lit(0).alias("part"), *[F.col(c).alias(k) for k, c in zip(BOX, ("b_lng", "b_lat", "b_lng", "b_lat"), strict=True)])
    places = at.select(F.lit(0).alias("part"), "lat", "lng").distinct()
    lat, lng = F.col("lat"), F.col("lng")
    n = nearest(places, things, lambda c: haversine(lat, lng, c("b_lat"), c("b_lng"), radius), sphere_gap(lat, lng, radius), ["b_id"], leaf=leaf)
    return at.select("id", "lat", "lng").join(n.select("lat", "lng", F.col("cost").alias("d"), F.col("found.b_id").alias("nearest")), ["lat", "lng"]).select("id", "nearest", "d")


def boundary_distances(stations: DataFrame, boundary: DataFrame, radius: float = 6371008.8) -> DataFrame:
    """``id, b_id, d``: the distance of every station to every boundary point, one row each; the output is all pairs by definition."""
    b = boundary.select(F.col("id").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"))
    return stations.crossJoin(b).select("id", "b_id", haversine(F.col("lat"), F.col("lng"), F.col("b_lat"), F.col("b_lng"), radius).alias("d"))


def drop_near(samples: DataFrame, reference: DataFrame, distance: float = 22.0) -> DataFrame:
    """``samples`` without those at most ``distance`` from a reference point.

    All of a cell of side ``distance`` over the root of two are near each other, so a
    sample whose cell has a reference point goes at once; only the others meet points pair by pair.
    """
    side = distance / 2**0.5 * (1 - 1e-6)  # what rounding of a coordinate may add
    cell = lambda c: F.floor(F.when(F.abs(F.col(c)) < side * 1e9, F.col(c)) / side)
    held = reference.select(cell("x").alias("_gx"), cell("y").alias("_gy")).distinct()
    samples = samples.withColumn("_gx", cell("x")).withColumn("_gy", cell("y")).join(held, ["_gx", "_gy"], "left_anti").drop("_gx", "_gy")
    finite = samples.where((F.abs(F.col("x")) < float("inf")) & (F.abs(F.col("y")) < float("inf")))
    return samples.join(pairs_within(finite, reference, distance).select("id"), "id", "left_anti")


def ranked(df: DataFrame, by: str, score: str = "score", tie: str = "id") -> DataFrame:
    """Adds ``rank`` from 1 and ``score100``, rounded half up."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), tie))).withColumn("score100", F.floor(F.col(score) * 100 + 0.5))


def hotspots(candidates: DataFrame, n: int = 8, stand_gap: float = 85.0, target_gap: float = 90.0, most: int = 1600) -> DataFrame:
    """Greedy choice for each scene of ``candidates(scene, id, tx, ty, sx, sy, score)``.

    The ``most`` best candidates of a scene (a parameter of the operator) are
    taken by falling score, then id; one is kept if its stand and its target are
    far enough from every kept one; remaining places are filled on the stand's
    distance alone.
    """
    import numpy as np
    import pandas as pd

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True])
        kept: list[int] = []
        stand, target = rows[["sx", "sy"]].to_numpy(float), rows[["tx", "ty"]].to_numpy(float)
        for both in (True, False):
            for k in range(len(rows)):
                if len(kept) >= n:
                    break
                if k in kept:
                    continue
                far = np.hypot(*(stand[kept] - stand[k]).T).min(initial=np.inf) >= stand_gap
                if far and both:
                    far = np.hypot(*(target[kept] - target[k]).T).min(initial=np.inf) >= target_gap
                if far:
                    kept.append(k)
        return rows.iloc[kept].assign(rank=range(1, len(kept) + 1))[["scene", "id", "score", "rank"]]

    cut = F.row_number().over(W.partitionBy("scene").orderBy(F.desc("score"), "id"))
    rows = candidates.withColumn("k", cut).where(F.col("k") <= most).drop("k")
    scene, key = (candidates.schema[c].dataType.simpleString() for c in ("scene", "id"))
    return rows.groupBy("scene").applyInPandas(pick, f"scene {scene}, id {key}, score double, rank long")


def _priority_round(active: DataFrame, places: list[tuple[str, str, float]]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``active(scene, id, score, ..., p)`` that nobody near them beats, and the others that are not too near one of those.

    A cell's side is the gap over the root of two: all of a cell are too near each
    other, and what is too near a row lies within two cells. So a row is compared
    with the best row of each of 25 cells, and has to leave for one row of each at most.
    """
    cell = lambda df, x, y, gap: df.withColumn("gx", F.floor(F.col(x) / (gap / 2**0.5))).withColumn("gy", F.floor(F.col(y) / (gap / 2**0.5)))
    won = active
    for x, y, gap in places:
        best = cell(active, x, y, gap).groupBy("scene", "gx", "gy").agg(F.min("p").alias("best"))
        around = spread(best, 2).groupBy("scene", "gx", "gy").agg(F.min("best").alias("best"))
        won = cell(won, x, y, gap).join(around, ["scene", "gx", "gy"]).where("p <= best").drop("gx", "gy", "best")
    won = settled(won)
    left = active.join(won.select("scene", "id"), ["scene", "id"], "left_anti")
    return won, _not_near(left, won, places)


def _not_near(rows: DataFrame, kept: DataFrame, places: list[tuple[str, str, float]]) -> DataFrame:
    """The ``rows`` that are at least a gap from every one of ``kept`` in each of the places; of ``kept`` a cell holds one row at most."""
    for x, y, gap in places:
        side = gap / 2**0.5
        grid = lambda c, side=side: F.floor(c / side)
        k = spread(kept.select("scene", F.col(x).alias("kx"), F.col(y).alias("ky"), grid(F.col(x)).alias("gx"), grid(F.col(y)).alias("gy")), 2)
        r = rows.withColumn("gx", grid(F.col(x))).withColumn("gy", grid(F.col(y)))
        d = F.sqrt(F.pow(F.col(x) - F.col("kx"), 2) + F.pow(F.col(y) - F.col("ky"), 2))
        near = r.select("scene", "id", x, y, "gx", "gy").join(k, ["scene", "gx", "gy"]).where(d < gap).select("scene", "id").distinct()
        rows = rows.join(near, ["scene", "id"], "left_anti")
    return rows


def _first_apart(rows: DataFrame, n: int, places: list[tuple[str, str, float]]) -> DataFrame:
    """The first ``n`` rows of each scene that a greedy walk by ``p`` keeps, each at least the gaps from all kept before."""
    active, kept = settled(rows), rows.limit(0)
    while not active.isEmpty():
        won, left = _priority_round(active, places)
        kept = settled(kept.unionByName(won))
        rank = F.row_number().over(W.partitionBy("scene").orderBy("p"))
        kept = kept.withColumn("k", rank).where(F.col("k") <= n)  # at most n rows of a scene go on
        last = kept.where(F.col("k") == n).select("scene", F.col("p").alias("last"))
        kept = settled(kept.drop("k"))
        # kept rows only grow in number, so what is worse than the n-th can never be among the first n
        active = settled(left.join(last, "scene", "left").where("last is null or p < last").drop("last"))
    return kept


def hotspots_apart(candidates: DataFrame, n: int = 8, stand_gap: float = 85.0, target_gap: float = 90.0, allowed: Column | None = None) -> DataFrame:
    """:func:`hotspots` of all candidates, with no bound on their number: ``scene, id, score, rank``.

    The greedy choice is the same as a maximal independent set by priority: in each
    round every candidate that beats all within its reach is kept and its
    neighbours go, until none is left that could be among a scene's first ``n``.
    Candidates of one scene are spread over its grid cells, so no task holds a scene.
    ``allowed`` is tested once more before anything is picked; null counts as not.
    A null score, place or id is left out. Ids are distinct within a scene. Places
    left after the first pass are filled on the stand's distance alone.
    """
    rows = candidates.select("scene", "id", "tx", "ty", "sx", "sy", "score", *([allowed.alias("allowed")] if allowed is not None else []))
    if allowed is not None:
        rows = rows.where("allowed").drop("allowed")
    rows = rows.dropna(subset=["scene", "id", "tx", "ty", "sx", "sy", "score"]).withColumn("p", F.struct((-F.col("score")).alias("low"), "id"))
    stand = [("sx", "sy", stand_gap)] if stand_gap > 0 else []
    both = stand + ([("tx", "ty", target_gap)] if target_gap > 0 else [])
    first = _first_apart(rows, n, both)
    ranks = F.row_number().over(W.partitionBy("scene").orderBy("pass", "p"))
    full = first.groupBy("scene").count().where(F.col("count") >= n).select("scene")
    rest = rows.join(full, "scene", "left_anti").join(first.select("scene", "id"), ["scene", "id"], "left_anti")
    more = _first_apart(_not_near(rest, first, stand), n, stand)
    picked = first.withColumn("pass", F.lit(1)).unionByName(more.withColumn("pass", F.lit(2)))
    return picked.withColumn("rank", ranks.cast("long")).where(F.col("rank") <= n).select("scene", "id", "score", "rank")


def points_apart(points: DataFrame, n: int = 8, gap: float = 150.0) -> DataFrame:
    """The first ``n`` of ``points(scene, id, x, y, score)`` by score that lie at least ``gap`` apart: ``scene, id, score, rank``."""
    p = points.select("scene", "id", "score", *[F.col(c).alias(f"{k}{c}") for k in "st" for c in "xy"])
    return hotspots_apart(p, n, gap, 0.0)


def safe_hotspots(spots: DataFrame, exclusions: DataFrame, lines: DataFrame) -> DataFrame:
    """``spots(scene, id, tx, ty, sx, sy, score)`` with a rank anew, without those whose target or stand is excluded or whose path is blocked.

    ``exclusions(ax, ay, bx, by, buffer)`` as in :func:`blocked_points`, ``lines`` as in
    :func:`blocked_paths`. Ids are unique; a spot with a null place is never excluded.
    """
    for x, y in (("tx", "ty"), ("sx", "sy")):
        spots = spots.join(blocked_points(spots.select("id", F.col(x).alias("x"), F.col(y).alias("y")), exclusions), "id", "left_anti")
    paths = spots.select("id", F.col("sx").alias("px"), F.col("sy").alias("py"), F.col("tx").alias("qx"), F.col("ty").alias("qy"))
    return ranked(spots.join(blocked_paths(paths, lines).select("id"), "id", "left_anti").drop("rank"), "scene")
