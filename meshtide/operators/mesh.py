"""Triangle meshes: ``vertex(vertex_id, x, y)``, ``triangle(cell_id, a, b, c)`` and face tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtide.functions.scalar import gate_bucket
from meshtide.operators.graph import connected_components


def with_corners(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Adds ``ax .. cy``; triangles with unknown vertices have nulls."""
    out = triangles
    for k in "abc":
        out = out.join(vertices.select(F.col("vertex_id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")), k, "left")
    return out


def doubled_area() -> Column:
    return (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))


def triangle_geometry(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """``cell_id, a, b, c, area, x, y, reason``: counter-clockwise, with area and centroid; ``reason`` for repeated, unknown or collinear corners."""
    t = with_corners(triangles.select("cell_id", "a", "b", "c"), vertices).withColumn("d", doubled_area())
    reason = F.when((F.col("a") == F.col("b")) | (F.col("b") == F.col("c")) | (F.col("a") == F.col("c")), "repeated vertex").when(F.col("d").isNull(), "unknown vertex").when(F.col("d") == 0, "degenerate")
    turned = F.col("d") < 0
    return t.select("cell_id", "a", F.when(turned, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(turned, F.col("b")).otherwise(F.col("c")).alias("c"), (F.abs("d") / 2).alias("area"), ((F.col("ax") + F.col("bx") + F.col("cx")) / 3).alias("x"), ((F.col("ay") + F.col("by") + F.col("cy")) / 3).alias("y"), reason.alias("reason"))


def edge_incidence(triangles: DataFrame) -> DataFrame:
    """``lo, hi, left, right, n, kind``: interior (2 cells), boundary (1) or nonmanifold; left is the smaller cell."""
    pair = lambda p, q: F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"))
    e = triangles.select("cell_id", F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a"))).alias("e")).select("cell_id", "e.*")
    g = e.groupBy("lo", "hi").agg(F.min("cell_id").alias("left"), F.max("cell_id").alias("right"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n") == 1, "boundary").when(F.col("n") == 2, "interior").otherwise("nonmanifold")
    return g.select("lo", "hi", "left", F.when(F.col("n") > 1, F.col("right")).alias("right"), "n", kind.alias("kind"))


def face_geometry(edges: DataFrame, vertices: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds ``length``, midpoint ``mx, my`` and the distance of the two cells' centroids (null on the boundary)."""
    v = lambda k: vertices.select(F.col("vertex_id").alias(k), F.col("x").alias(f"{k}_x"), F.col("y").alias(f"{k}_y"))
    c = lambda k: cells.select(F.col("cell_id").alias(k), F.col("x").alias(f"{k}_cx"), F.col("y").alias(f"{k}_cy"))
    j = edges.join(v("lo"), "lo").join(v("hi"), "hi").join(c("left"), "left").join(c("right"), "right", "left")
    dist = lambda a, b, p, q: F.sqrt(F.pow(F.col(a) - F.col(b), 2) + F.pow(F.col(p) - F.col(q), 2))
    return j.select(*edges.columns, dist("lo_x", "hi_x", "lo_y", "hi_y").alias("length"), ((F.col("lo_x") + F.col("hi_x")) / 2).alias("mx"), ((F.col("lo_y") + F.col("hi_y")) / 2).alias("my"), dist("left_cx", "right_cx", "left_cy", "right_cy").alias("centre_distance"))


def face_normals(edges: DataFrame, vertices: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds the unit normal ``nx, ny`` of each edge, from its left to its right cell, or out of the mesh; null for edges without length.

    ``edges`` as :func:`edge_incidence` gives them, ``cells(cell_id, x, y)`` with centroids.
    """
    v = lambda k: vertices.select(F.col("vertex_id").alias(k), F.col("x").alias(f"{k}_x"), F.col("y").alias(f"{k}_y"))
    j = edges.join(v("lo"), "lo").join(v("hi"), "hi").join(cells.select(F.col("cell_id").alias("left"), F.col("x").alias("cx"), F.col("y").alias("cy")), "left")
    dx, dy = F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y")
    length = F.sqrt(dx * dx + dy * dy)
    away = F.signum(dy * ((F.col("lo_x") + F.col("hi_x")) / 2 - F.col("cx")) - dx * ((F.col("lo_y") + F.col("hi_y")) / 2 - F.col("cy")))
    return j.select(*edges.columns, F.try_divide(away * dy, length).alias("nx"), F.try_divide(-away * dx, length).alias("ny"))


def marked_boundary(edges: DataFrame, markers: DataFrame) -> DataFrame:
    """``lo, hi, cell_id, marker, problem``: boundary edges with the marker of ``markers(a, b, marker)``, ends in any order, and the markers that fit none.

    Boundary edges without a marker have null there. ``problem``: ``duplicate`` (several
    markers for one edge; the smallest is given), ``interior`` (marks an edge inside the mesh,
    or one with over two cells), ``unmatched`` (marks no edge at all).
    """
    m = markers.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "marker").groupBy("lo", "hi").agg(F.min("marker").alias("marker"), F.count(F.lit(1)).alias("times"))
    j = edges.select("lo", "hi", F.col("left").alias("cell_id"), F.col("kind")).join(m, ["lo", "hi"], "full_outer")
    problem = F.when(F.col("times").isNull(), None).when(F.col("kind").isNull(), "unmatched").when(F.col("kind") != "boundary", "interior").when(F.col("times") > 1, "duplicate")
    return j.where("kind = 'boundary' or times is not null").select("lo", "hi", F.when(F.col("kind") == "boundary", F.col("cell_id")).alias("cell_id"), "marker", problem.alias("problem"))


def cell_neighbours(edges: DataFrame) -> DataFrame:
    """``cell_id, neighbours`` (sorted)."""
    i = edges.where("kind = 'interior'")
    return i.select(F.col("left").alias("cell_id"), F.col("right").alias("other")).union(i.select("right", "left")).groupBy("cell_id").agg(F.sort_array(F.collect_set("other")).alias("neighbours"))


def closure_check(edges: DataFrame, vertices: DataFrame, cells: DataFrame) -> DataFrame:
    """``cell_id, nx, ny``: the length-weighted outward normals of a cell; zero sums for closed cells."""
    v = lambda k: vertices.select(F.col("vertex_id").alias(k), F.col("x").alias(f"{k}_x"), F.col("y").alias(f"{k}_y"))
    j = edges.join(v("lo"), "lo").join(v("hi"), "hi").select("lo_x", "lo_y", "hi_x", "hi_y", F.explode(F.array("left", "right")).alias("cell_id")).where("cell_id is not null").join(cells.select("cell_id", "x", "y"), "cell_id")
    nx, ny = F.col("hi_y") - F.col("lo_y"), F.col("lo_x") - F.col("hi_x")
    side = F.signum(nx * ((F.col("lo_x") + F.col("hi_x")) / 2 - F.col("x")) + ny * ((F.col("lo_y") + F.col("hi_y")) / 2 - F.col("y")))
    return j.groupBy("cell_id").agg(F.sum(side * nx).alias("nx"), F.sum(side * ny).alias("ny"))


def locate_in_mesh(points: DataFrame, triangles: DataFrame, vertices: DataFrame, bucket: float, tolerance: float = 1e-12, weights: bool = False) -> DataFrame:
    """``point_id, cell_id``: the containing triangle with the smallest id, null if none. Triangles and points meet in grid buckets.

    With ``weights`` also ``wa, wb, wc``: the point's barycentric weights for the corners in the table's order.
    """
    t = with_corners(triangles, vertices).where("ax is not null and bx is not null and cx is not null").withColumn("d", doubled_area()).where("d <> 0")
    span = lambda k: F.sequence(F.floor(F.least(*[F.col(f"{c}{k}") for c in "abc"]) / bucket), F.floor(F.greatest(*[F.col(f"{c}{k}") for c in "abc"]) / bucket))
    t = t.withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y")))
    p = points.select("point_id", "x", "y", F.floor(F.col("x") / bucket).alias("gx"), F.floor(F.col("y") / bucket).alias("gy"))
    w1 = ((F.col("bx") - F.col("x")) * (F.col("cy") - F.col("y")) - (F.col("by") - F.col("y")) * (F.col("cx") - F.col("x"))) / F.col("d")
    w2 = ((F.col("cx") - F.col("x")) * (F.col("ay") - F.col("y")) - (F.col("cy") - F.col("y")) * (F.col("ax") - F.col("x"))) / F.col("d")
    hit = p.join(t, ["gx", "gy"]).where((w1 >= -tolerance) & (w2 >= -tolerance) & (1 - w1 - w2 >= -tolerance)).groupBy("point_id").agg(F.min(F.struct("cell_id", w1.alias("wa"), w2.alias("wb"))).alias("h"))
    hit = hit.select("point_id", "h.cell_id", "h.wa", "h.wb", (1 - F.col("h.wa") - F.col("h.wb")).alias("wc"))
    return points.select("point_id").join(hit if weights else hit.select("point_id", "cell_id"), "point_id", "left")


def _keyed(faces: DataFrame, side: str, by: tuple[str, ...]) -> DataFrame:
    """Faces under their sorted vertex pair and ``by``, every other column named after its side; columns that are not there are null."""
    given = lambda k, kind: F.col(k).cast(kind) if k in faces.columns else F.lit(None).cast(kind)
    cells = (F.least("left", "right").alias(f"{side}1"), F.greatest("left", "right").alias(f"{side}2"))
    rest = [given(k, kind).alias(f"{side}_{k}") for k, kind in (("length", "double"), ("centre_distance", "double"), ("mx", "double"), ("my", "double"), ("marker", "string"))]
    return faces.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), *by, *cells, *rest, F.lit(True).alias(f"{side}_there"))


def compare_faces(exported: DataFrame, rebuilt: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row about two ``(a, b, left, right, length[, centre_distance, mx, my, marker])`` tables, matched by unordered vertex pair.

    ``matched``, ``missing`` and ``extra`` faces, ``duplicate`` exported rows, ``cell_mismatch``,
    ``marker_mismatch``, and the largest relative length, relative centre distance and
    absolute midpoint errors of matched rows (null where nothing can be compared).
    ``rebuilt`` has each pair once. With ``by`` there is a row for each value of those columns, by which faces are matched too.
    """
    again = F.row_number().over(W.partitionBy("lo", "hi", *by).orderBy(F.col("e1").asc_nulls_last(), F.col("e2").asc_nulls_last())) > 1
    j = _keyed(exported, "e", by).withColumn("again", again).join(_keyed(rebuilt, "r", by), ["lo", "hi", *by], "full_outer")
    e, r = F.col("e_there").isNotNull(), F.col("r_there").isNotNull()
    relative = lambda k: F.abs(F.col(f"e_{k}") - F.col(f"r_{k}")) / F.greatest(F.lit(1.0), F.abs(f"e_{k}"), F.abs(f"r_{k}"))
    off = ~(F.col("e1").eqNullSafe(F.col("r1")) & F.col("e2").eqNullSafe(F.col("r2")))
    return j.groupBy(*by).agg(
        F.count_if(e & r).alias("matched"), F.count_if(e & ~r).alias("extra"), F.count_if(~e & r).alias("missing"), F.count_if(e & r & F.col("again")).alias("duplicate"), F.count_if(e & r & off).alias("cell_mismatch"),
        F.count_if(e & r & ~F.col("e_marker").eqNullSafe(F.col("r_marker"))).alias("marker_mismatch"), F.max(relative("length")).alias("length_error"), F.max(relative("centre_distance")).alias("centre_error"),
        F.max(F.hypot(F.col("e_mx") - F.col("r_mx"), F.col("e_my") - F.col("r_my"))).alias("midpoint_error"))


def mesh_audit(triangles: DataFrame, vertices: DataFrame, exported: dict[str, DataFrame] | None = None, tolerance: float = 1e-9, markers: DataFrame | None = None) -> DataFrame:
    """``check, value, expected, ok`` of a mesh and of what was exported from it.

    Always: bad cells, nonmanifold edges, components, least and total area. With
    ``exported`` also the other named checks: ``vertices``, ``triangles(cell_id, a, b, c)`` and
    ``faces(a, b, left, right, length, centre_distance, mx, my, marker)``, where a face without a
    right cell lies on the boundary. ``markers(a, b, marker)`` names the boundary's edges. An empty
    mesh has null areas, which are not ok.
    """
    g, e = triangle_geometry(triangles, vertices), edge_incidence(triangles)
    parts = connected_components(e.where("kind = 'interior'").select(F.col("left").alias("src"), F.col("right").alias("dst")).union(triangles.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"))), near=F.floor(F.col("src") / 65_536))
    num = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")

    def checks(facts: DataFrame, *rules: tuple) -> DataFrame:
        """Rows of one-row ``facts`` for (name, value, comparison, expected)."""
        fits = {"=": lambda v, x: v == x, "<=": lambda v, x: v <= x, ">": lambda v, x: v > x}
        rows = [F.struct(F.lit(name).alias("check"), num(v).alias("value"), num(x).alias("expected"), F.coalesce(fits[how](num(v), num(x)), F.lit(False)).alias("ok")) for name, v, how, x in rules]
        return facts.select(F.explode(F.array(*rows)).alias("c")).select("c.*")

    out = checks(g.agg(F.count_if(F.col("reason").isNotNull()).alias("bad"), F.min("area").alias("least"), F.sum("area").alias("total")), ("bad cells", F.col("bad"), "=", 0), ("least area", F.col("least"), ">", 0), ("total area", F.col("total"), ">", 0))
    out = out.union(checks(e.agg(F.count_if(F.col("kind") == "nonmanifold").alias("n")), ("nonmanifold edges", F.col("n"), "=", 0)))
    out = out.union(checks(parts.agg(F.count_distinct("component").alias("n")), ("components", F.col("n"), "=", 1)))
    if exported is None:
        return out
    size = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    sizes = size(vertices, "v").join(size(exported["vertices"], "ev")).join(size(triangles, "t")).join(size(exported["triangles"], "et"))
    out = out.union(checks(sizes, ("vertex count", F.col("v"), "=", F.col("ev")), ("cell count", F.col("t"), "=", F.col("et"))))
    corners = lambda d, name: d.select("cell_id", F.array_sort(F.array("a", "b", "c")).alias(name))
    sets = corners(triangles, "p").join(corners(exported["triangles"], "q"), "cell_id", "full_outer").agg(F.count_if(~F.col("p").eqNullSafe(F.col("q"))).alias("n"))
    out = out.union(checks(sets, ("triangle vertex sets", F.col("n"), "=", 0)))
    rebuilt = face_geometry(e, vertices, g).withColumnsRenamed({"lo": "a", "hi": "b"})
    if markers is not None:
        rebuilt = rebuilt.join(markers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "marker").distinct(), ["a", "b"], "left")
    theirs = exported["faces"].withColumn("kind", F.when(F.col("right").isNull(), "boundary").otherwise("interior"))
    found = compare_faces(theirs, rebuilt.where("kind <> 'nonmanifold'"), ("kind",))
    facts = found.agg(F.map_from_entries(F.collect_list(F.struct("kind", F.struct(*found.columns[1:]).alias("f")))).alias("of"))  # two rows
    rules = []
    for kind in ("interior", "boundary"):
        count = lambda k, kind=kind: F.coalesce(F.col("of")[kind][k], F.lit(0))
        # without matched faces there is nothing to measure, hence no error
        error = lambda k, kind=kind: F.when(F.coalesce(F.col("of")[kind]["matched"], F.lit(0)) == 0, 0.0).otherwise(F.col("of")[kind][k])
        rules += [
            (f"{kind} face count", count("matched") - count("duplicate") + count("missing"), "=", count("matched") + count("extra")), (f"{kind} edges", count("missing") + count("extra") + count("duplicate"), "=", 0),
            (f"{kind} cells", count("cell_mismatch"), "=", 0), (f"{kind} length error", error("length_error"), "<=", tolerance), (f"{kind} midpoint error", error("midpoint_error"), "<=", tolerance),
            (f"{kind} centre distance error", error("centre_error"), "<=", tolerance) if kind == "interior" else (f"{kind} markers", count("marker_mismatch"), "=", 0)]
    return out.union(checks(facts, *rules))


def quantised(points: DataFrame, scale: float = 1000.0) -> DataFrame:
    """Adds ``qx, qy``: whole thousandths around the mean point, rounded half to even."""
    centre = points.agg(F.avg("x").alias("ox"), F.avg("y").alias("oy"))
    return points.crossJoin(F.broadcast(centre)).withColumn("qx", F.rint((F.col("x") - F.col("ox")) * scale).cast("int")).withColumn("qy", F.rint((F.col("y") - F.col("oy")) * scale).cast("int")).drop("ox", "oy")


def cut_components(cells: DataFrame, faces: DataFrame, gone: DataFrame) -> DataFrame:
    """``cell_id, x, y, component`` of the ``cells(cell_id, x, y)`` that ``faces(face_id, left, right)`` link, without the faces ``gone(face_id)``.

    A component is named by its smallest cell; a cell without neighbours is its own.
    """
    links = faces.where("left is not null and right is not null").select("face_id", F.col("left").alias("src"), F.col("right").alias("dst"))
    cut = links.join(gone.select("face_id").distinct(), "face_id", "left_semi").select("src", "dst")
    alone = cells.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"))
    found = connected_components(links.select("src", "dst").union(alone), cut=cut, near=F.floor(F.col("src") / 65_536))
    return cells.select("cell_id", "x", "y").join(found.withColumnRenamed("node", "cell_id"), "cell_id")


def cut_faces(faces: DataFrame, line: tuple[float, float, float, float], marked: DataFrame | None = None, gates: int = 8) -> DataFrame:
    """``face_id, gate``: faces whose centroid-to-centroid path crosses ``line``, and the ``marked(face_id)`` ones.

    ``faces(face_id, lx, ly, rx, ry, mx, my)``. Both centroids lie strictly on
    different sides and the path meets the segment, ends included. ``gate`` numbers
    the line's part nearest to the face's midpoint. Boundary faces have a null right centroid and are never cut.
    """
    px, py, qx, qy = line
    vx, vy = qx - px, qy - py
    side = lambda x, y: vx * (F.col(y) - py) - vy * (F.col(x) - px)
    left, right = side("lx", "ly"), side("rx", "ry")
    at = left / (left - right)
    x, y = F.col("lx") + at * (F.col("rx") - F.col("lx")), F.col("ly") + at * (F.col("ry") - F.col("ly"))
    along = lambda x, y: ((x - px) * vx + (y - py) * vy) / (vx * vx + vy * vy)
    crossed = F.coalesce((left * right < 0) & along(x, y).between(0.0, 1.0), F.lit(False))
    f = faces
    if marked is not None:
        f = f.join(marked.select("face_id").distinct().withColumn("marked", F.lit(True)), "face_id", "left")
        crossed = crossed | F.coalesce("marked", F.lit(False))
    return f.where(crossed).select("face_id", gate_bucket(along(F.col("mx"), F.col("my")), gates).alias("gate"))


def rasterised_cells(triangles: DataFrame, vertices: DataFrame, width: int, height: int, margin: float = 0.025) -> DataFrame:
    """``row, col, cell_id``: the triangle at each pixel's centre, on square pixels over the mesh's padded bounds; row 0 is at the top.

    A centre on a common side or corner belongs to the larger cell id. A triangle
    visits the pixels of its own box only.
    """
    b = vertices.agg(*[f(k).alias(f"{n}_{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in "xy"])
    span = lambda k: F.col(f"hi_{k}") - F.col(f"lo_{k}") + 2 * F.greatest(F.lit(1e-6), (F.col(f"hi_{k}") - F.col(f"lo_{k}")) * margin)
    b = b.select(F.greatest(span("x") / width, span("y") / height).alias("px"), ((F.col("lo_x") + F.col("hi_x")) / 2).alias("mid_x"), ((F.col("lo_y") + F.col("hi_y")) / 2).alias("mid_y"))
    t = with_corners(triangles.select("cell_id", "a", "b", "c"), vertices).join(F.broadcast(b)).withColumn("d", doubled_area()).where("d <> 0")
    col = lambda x: (x - F.col("mid_x")) / F.col("px") + width / 2 - 0.5
    row = lambda y: (F.col("mid_y") - y) / F.col("px") + height / 2 - 0.5
    ends = lambda f, k, n: F.sequence(F.greatest(F.lit(0), F.floor(F.least(*[f(F.col(f"{c}{k}")) for c in "abc"])).cast("int")), F.least(F.lit(n - 1), F.ceil(F.greatest(*[f(F.col(f"{c}{k}")) for c in "abc"])).cast("int")))
    t = t.withColumn("col", F.explode(ends(col, "x", width))).withColumn("row", F.explode(ends(row, "y", height)))
    t = t.withColumn("x", F.col("mid_x") + (F.col("col") + 0.5 - width / 2) * F.col("px")).withColumn("y", F.col("mid_y") - (F.col("row") + 0.5 - height / 2) * F.col("px"))
    w1 = ((F.col("bx") - F.col("x")) * (F.col("cy") - F.col("y")) - (F.col("by") - F.col("y")) * (F.col("cx") - F.col("x"))) / F.col("d")
    w2 = ((F.col("cx") - F.col("x")) * (F.col("ay") - F.col("y")) - (F.col("cy") - F.col("y")) * (F.col("ax") - F.col("x"))) / F.col("d")
    inside = (w1 >= -1e-12) & (w2 >= -1e-12) & (1 - w1 - w2 >= -1e-12)
    return t.where(inside).groupBy("row", "col").agg(F.max("cell_id").alias("cell_id"))


def raster_coverage(grid: DataFrame, triangles: DataFrame) -> DataFrame:
    """One row ``cells, represented, fraction``; see also :func:`omitted_cells`."""
    r = triangles.select("cell_id").join(grid.select("cell_id").distinct().withColumn("there", F.lit(True)), "cell_id", "left").agg(F.count(F.lit(1)).alias("cells"), F.count("there").alias("represented"))
    return r.withColumn("fraction", F.when(F.col("cells") > 0, F.col("represented") / F.col("cells")))


def omitted_cells(grid: DataFrame, triangles: DataFrame) -> DataFrame:
    """``cell_id`` of the triangles that no pixel shows."""
    return triangles.select("cell_id").join(grid.select("cell_id"), "cell_id", "left_anti")
