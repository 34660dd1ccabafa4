"""Graph jobs: connected components and balances on weighted graphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshtide.session import TASK_ROWS, checkpointed, digest, settled


#: Edges that a task contracts at once (two longs each).
CHUNK_EDGES = 1 << 20


def least_reachable(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of the nodes 0..n-1 the smallest one that the links u-v lead to."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return root


def _stars(batches):
    """``node, root`` of the edges in some batches at a time: the smallest node that they lead to."""

    def star(parts):
        nodes, ends = np.unique(np.concatenate(parts), return_inverse=True)
        half = len(ends) // 2
        root = least_reachable(len(nodes), ends[:half], ends[half:])
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])

    u, v, held = [], [], 0
    for b in batches:
        u.append(b.column(0).to_numpy())
        v.append(b.column(1).to_numpy())
        held += b.num_rows
        if held >= CHUNK_EDGES:
            yield star(u + v)
            u, v, held = [], [], 0
    if held:
        yield star(u + v)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", cut: DataFrame | None = None, near: Column | None = None, max_rounds: int = 60) -> DataFrame:
    """Labels each node of an undirected edge table with its component's smallest node.

    Each task first contracts the edges it has to stars (node, smallest node that
    they lead to). A node that several stars share is a border node; only the stars'
    centres and what the border nodes say of them go on, so the loop that follows
    works on borders alone. ``near`` names what lies together (a tile of space):
    with it the edges are dealt by it first, and few nodes are border nodes.
    ``cut(src, dst)`` names edges, in either direction, that do not link.

    The loop alternates large-star and small-star rounds: every round hangs neighbours
    under smaller nodes, so long chains shrink geometrically and no node's
    neighbours are ever collected; both steps are a ``min`` per node (combined
    before the shuffle) and an equi-join that adaptive execution may split.
    Each round is checkpointed; the loop ends when the edges no longer change.

    Null ends and self loops contribute a node each but no link, and so does a cut
    edge to each of its ends. An empty table gives an empty result. Ids are
    integers. Columns of the result: ``node``, ``component``.
    """
    kind = edges.select(src).schema[0].dataType.simpleString()
    low, high = F.least("u", "v"), F.greatest("u", "v")
    pairs = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v"), *([near.alias("near")] if near is not None else []))
    pairs = pairs.withColumn("u", F.coalesce("u", "v")).withColumn("v", F.coalesce("v", "u")).where("u is not null")
    if cut is not None:
        gone = cut.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v")).select(low.alias("a"), high.alias("b"), F.lit(True).alias("gone")).distinct()
        pairs = pairs.withColumn("a", low).withColumn("b", high).join(gone, ["a", "b"], "left")
        ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = F.when(F.col("gone") & (F.col("u") != F.col("v")), F.transform(ends, lambda x: F.struct(x["u"].alias("u"), x["u"].alias("v")))).otherwise(F.slice(ends, 1, 1))
        pairs = pairs.withColumn("e", F.explode(ends)).select("e.u", "e.v", *(["near"] if near is not None else []))
    if near is not None:
        pairs = pairs.repartition("near")
    stars = settled(pairs.select("u", "v").mapInArrow(_stars, "node long, root long"))
    border = stars.groupBy("node").agg(F.min("root").alias("low"), F.count(F.lit(1)).alias("times")).where("times > 1")
    met = stars.join(border, "node").where("root <> low").select(F.col("low").alias("u"), F.col("root").alias("v"))
    e = settled(met.select(low.alias("u"), high.alias("v")).distinct())
    n, last = digest(e)
    while n:
        e = checkpointed(_round(e).coalesce(max(1, -(-n // TASK_ROWS))))  # rounds never add edges
        now = digest(e)
        if now == (n, last):
            break
        (n, last), max_rounds = now, max_rounds - 1
        if not max_rounds:
            raise RuntimeError("components did not settle")
    of = e.select(F.col("v").alias("root"), F.col("u").alias("component"))
    found = stars.join(of, "root", "left").groupBy("node").agg(F.min(F.coalesce("component", "root")).alias("component"))
    return found.select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))


def _round(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges ``u < v``."""
    both = e.union(e.select("v", "u"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
    low = large.groupBy("v").agg(F.min("u").alias("m"))
    hung = large.join(low, "v")
    return hung.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v")).union(low.select(F.col("m").alias("u"), "v")).distinct()


def edge_flux(edges: DataFrame, nodes: DataFrame, weight: Column | None = None) -> DataFrame:
    """``edges(edge_id,left,right,w)`` with ``flux = w*(value(left)-value(right))``.

    A missing node or null value gives a null flux. Ids may repeat in ``edges``.
    """
    w = F.col("w") if weight is None else weight
    n = nodes.select("node_id", "value")
    a = n.select(F.col("node_id").alias("left"), F.col("value").alias("left_value"))
    b = n.select(F.col("node_id").alias("right"), F.col("value").alias("right_value"))
    return edges.join(a, "left", "left").join(b, "right", "left").withColumn("flux", w * (F.col("left_value") - F.col("right_value")))


def stacked(flux: DataFrame) -> DataFrame:
    """Two rows for each edge: what leaves the left node and enters the right one."""
    return flux.select(F.explode(F.array(
        F.struct(F.col("left").alias("node_id"), F.col("flux").alias("out")),
        F.struct(F.col("right").alias("node_id"), (-F.col("flux")).alias("out")),
    )).alias("x")).select("x.*")


def node_balance(edges: DataFrame, nodes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Residual of each node: fluxes out of it, less its source.

    Nodes without edges have residual ``-source``; null sources count as zero.
    Columns: ``node_id``, ``residual``.
    """
    parts = stacked(edge_flux(edges, nodes)).union(nodes.select("node_id", F.lit(0.0)))
    if sources is not None:
        parts = parts.union(sources.select("node_id", -F.coalesce(F.col("source"), F.lit(0.0))))
    return parts.groupBy("node_id").agg(F.coalesce(F.sum("out"), F.lit(0.0)).alias("residual"))


def node_rate(edges: DataFrame, nodes: DataFrame, capacities: DataFrame, boundaries: DataFrame | None = None, multipliers: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Time derivative of each node value.

    ``boundaries(node_id, kind, coefficient, value)``: kind ``dirichlet`` lets
    ``coefficient*(node value - value)`` out of the node, kind ``flux`` lets
    ``value`` out; other kinds are ignored. ``multipliers(edge_id, multiplier)``
    scales edges, 1 where absent. Null or zero capacity gives a null rate;
    capacities that are stated twice count once. A node of several rows has each
    of its values: edges and boundaries count for each of them.
    Columns: ``node_id``, ``outflow``, ``source``, ``boundary``, ``rate``.
    """
    e = edges
    if multipliers is not None:
        e = e.join(multipliers.select("edge_id", "multiplier"), "edge_id", "left").withColumn("w", F.col("w") * F.coalesce("multiplier", F.lit(1.0)))
    zero = F.lit(0.0)
    rows = stacked(edge_flux(e, nodes)).select("node_id", F.col("out").alias("inner"), zero.alias("source"), zero.alias("boundary"))
    rows = rows.union(nodes.select("node_id", zero, zero, zero))
    if sources is not None:
        rows = rows.union(sources.select("node_id", zero, F.coalesce("source", zero), zero))
    if boundaries is not None:
        b = boundaries.select("node_id", "kind", "coefficient", F.col("value").alias("outer")).join(nodes.select("node_id", "value"), "node_id")
        out = F.when(F.col("kind") == "dirichlet", F.col("coefficient") * (F.col("value") - F.col("outer"))).when(F.col("kind") == "flux", F.col("outer")).otherwise(zero)
        rows = rows.union(b.select("node_id", zero, zero, out))
    total = rows.groupBy("node_id").agg(F.sum("inner").alias("inner"), F.sum("source").alias("source"), F.sum("boundary").alias("boundary"))
    outflow = F.col("inner") + F.col("boundary")
    return total.join(capacities.select("node_id", "capacity").distinct(), "node_id", "left").select("node_id", outflow.alias("outflow"), "source", "boundary", F.when(F.col("capacity") != 0, (F.col("source") - outflow) / F.col("capacity")).alias("rate"))


def rate_totals(rates: DataFrame, capacities: DataFrame) -> DataFrame:
    """One row ``source, boundary, mass_rate, imbalance`` of :func:`node_rate`: sums over all nodes.

    ``mass_rate`` is the sum of capacity times rate; inner fluxes cancel, so
    ``imbalance = mass_rate - (source - boundary)`` is rounding alone, unless a node without
    capacity keeps a flux. ``boundary`` counts what leaves. Capacities that are stated twice count once.
    """
    held = F.col("capacity") * F.col("rate")
    r = rates.join(capacities.select("node_id", "capacity").distinct(), "node_id", "left")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    r = r.agg(total(F.col("source")).alias("source"), total(F.col("boundary")).alias("boundary"), total(held).alias("mass_rate"))
    return r.withColumn("imbalance", F.col("mass_rate") - (F.col("source") - F.col("boundary")))


def stable_step(edges: DataFrame, capacities: DataFrame, boundaries: DataFrame | None = None, safety: float = 0.9) -> DataFrame:
    """One row ``dt``: the smallest safety*capacity/(sum of weights) over the nodes with weight; null if none has."""
    deg = edges.select(F.explode(F.array("left", "right")).alias("node_id"), "w")
    if boundaries is not None:
        deg = deg.union(boundaries.where("kind = 'dirichlet'").select("node_id", "coefficient"))
    deg = deg.groupBy("node_id").agg(F.sum("w").alias("w")).where("w > 0")
    return deg.join(capacities.select("node_id", "capacity"), "node_id").agg(F.min(F.lit(safety) * F.col("capacity") / F.col("w")).alias("dt"))


def drain_limiter(faces: DataFrame, cells: DataFrame, dt: float) -> DataFrame:
    """Scales each flux so that no cell gives more than it holds within ``dt``.

    ``faces(face_id,left,right,flux)``: positive goes left to right;
    ``cells(cell_id, available)``. Each flux is scaled by its donor's
    ``alpha = min(1, available/(dt*outgoing))``. A donor not in ``cells`` or
    without stock has alpha 0. Columns: ``face_id,left,right,flux,alpha,limited``.
    """
    f = faces.select("face_id", "left", "right", "flux").withColumn("donor", F.when(F.col("flux") >= 0, F.col("left")).otherwise(F.col("right")))
    out = f.groupBy("donor").agg(F.sum(F.abs("flux")).alias("out"))
    have = cells.select(F.col("cell_id").alias("donor"), "available")
    a = out.join(have, "donor", "left").select("donor", F.when(F.col("out") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("available", F.lit(0.0))) / (F.lit(dt) * F.col("out")))).alias("alpha"))
    return f.join(a, "donor", "left").select("face_id", "left", "right", "flux", "alpha", (F.col("flux") * F.col("alpha")).alias("limited"))


def edge_multipliers(edges: DataFrame, gate_map: DataFrame, openings: DataFrame) -> DataFrame:
    """``edge_id, multiplier``: the opening of the edge's gate, 1 for edges without one (or with an unknown one).

    ``openings(gate, opening)`` may hold one row with a null gate: the uniform opening.
    """
    uniform = openings.where("gate is null").agg(F.first("opening").alias("uniform"))
    named = openings.where("gate is not null").select("gate", "opening")
    m = edges.select("edge_id").join(gate_map.select("edge_id", "gate"), "edge_id", "left").join(named, "gate", "left").crossJoin(F.broadcast(uniform))
    return m.select("edge_id", F.coalesce("opening", F.when(F.col("gate").isNotNull(), F.col("uniform")), F.lit(1.0)).alias("multiplier"))


def distribute_by_length(totals: DataFrame, faces: DataFrame) -> DataFrame:
    """Shares ``totals(id,total)`` over ``faces(id,ix,length)`` by length within each id.

    Ids without a total, or of zero length, get null shares. Columns ``id, ix, share``.
    """
    s = faces.groupBy("id").agg(F.sum("length").alias("whole"))
    return faces.select("id", "ix", "length").join(s, "id").join(totals.select("id", "total"), "id", "left").select("id", "ix", F.when(F.col("whole") > 0, F.col("total") * F.col("length") / F.col("whole")).alias("share"))


def share_sums(shares: DataFrame, totals: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """``id, total, shared, ok``: whether the shares of each of ``totals(id, total)`` sum to it, relative to the larger of 1 and the total.

    Totals without faces have a null ``shared`` and are not ok.
    """
    s = shares.groupBy("id").agg(F.sum("share").alias("shared"))
    ok = F.abs(F.col("shared") - F.col("total")) <= tolerance * F.greatest(F.lit(1.0), F.abs("total"))
    return totals.select("id", "total").join(s, "id", "left").select("id", "total", "shared", F.coalesce(ok, F.lit(False)).alias("ok"))


def integral(df: DataFrame, value: str = "value", weight: str = "weight") -> DataFrame:
    """One row ``integral``: the sum of value times weight; negative weights are refused with null."""
    bad = F.sum(F.when(F.col(weight) < 0, 1).otherwise(0))
    return df.agg(F.when(bad == 0, F.sum(F.col(value) * F.col(weight))).alias("integral"))


def structure_sources(structures: DataFrame) -> DataFrame:
    """``cell_id, mass, momentum_x, momentum_y`` that ``structures(cell_a, cell_b, discharge, dir_x, dir_y, speed)`` take from a and give to b.

    What leaves one cell enters the other, so each column sums to zero. Momentum is
    the discharge times the speed in its direction (a unit vector is made of it);
    a null or zero direction, or a null speed, carries none. Structures with a null
    discharge, a null cell or one cell twice are left out.
    """
    norm = F.sqrt(F.pow("dir_x", 2) + F.pow("dir_y", 2))
    q = F.col("discharge")
    carried = q * F.signum(q) * F.coalesce("speed", F.lit(0.0))
    along = lambda c: F.coalesce(carried * F.try_divide(F.col(c), norm), F.lit(0.0))
    s = structures.where("discharge is not null and cell_a is not null and cell_b is not null and cell_a <> cell_b").select("cell_a", "cell_b", q.alias("m"), along("dir_x").alias("px"), along("dir_y").alias("py"))
    ends = F.array(F.struct(F.col("cell_a").alias("cell_id"), (-F.col("m")).alias("m"), (-F.col("px")).alias("px"), (-F.col("py")).alias("py")), F.struct(F.col("cell_b").alias("cell_id"), "m", "px", "py"))
    return s.select(F.explode(ends).alias("e")).groupBy("e.cell_id").agg(F.sum("e.m").alias("mass"), F.sum("e.px").alias("momentum_x"), F.sum("e.py").alias("momentum_y"))
