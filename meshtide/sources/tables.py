"""Readers and writers for the stored forms: raster chunks, mesh chunks, vector layers, packed arrays, file manifests."""

from __future__ import annotations

import gzip
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RASTER_CHUNK = "startRow int, rows array<array<int>>"
MESH_CHUNK = "schema string, kind string, start long, values array<array<double>>"
FEATURES = "features array<struct<type:string, properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"


def raster_rows(chunks: DataFrame) -> DataFrame:
    """``row, run_ix, x0, x1`` from chunks of flat run lists; odd trailing ends are dropped (see :func:`raster_problems`)."""
    r = chunks.select("startRow", F.posexplode("rows").alias("k", "ends")).select((F.col("startRow") + F.col("k")).alias("row"), "ends")
    n = F.floor(F.size("ends") / 2).cast("int")
    ix = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return r.select("row", "ends", F.explode(ix).alias("run_ix")).select("row", "run_ix", F.element_at("ends", F.col("run_ix") * 2 + 1).alias("x0"), F.element_at("ends", F.col("run_ix") * 2 + 2).alias("x1"))


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    return raster_rows(spark.read.schema(RASTER_CHUNK).json(path, multiLine=True))


def raster_problems(chunks: DataFrame, height: int) -> DataFrame:
    """``row, problem``: duplicate, outside, missing or odd rows."""
    r = chunks.select("startRow", F.posexplode("rows").alias("k", "ends")).select((F.col("startRow") + F.col("k")).cast("long").alias("row"), F.size("ends").alias("n"))
    g = r.groupBy("row").agg(F.count(F.lit(1)).alias("times"), F.max(F.col("n") % 2).alias("odd"))
    problem = F.when(F.col("times") > 1, "duplicate").when((F.col("row") < 0) | (F.col("row") >= height), "outside").when(F.col("odd") == 1, "odd")
    missing = chunks.sparkSession.range(height).withColumnRenamed("id", "row").join(g, "row", "left_anti").select("row", F.lit("missing").alias("problem"))
    return g.select("row", problem.alias("problem")).where("problem is not null").union(missing)


def mesh_chunks(table: DataFrame, kind: str, index: str, size: int = 10_000) -> DataFrame:
    """``kind, start, count, values, checksum`` rows of at most ``size`` indexed rows each."""
    columns = [c for c in table.columns if c != index]
    row = F.struct(F.col(index).alias("i"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    g = table.groupBy(F.floor(F.col(index) / size).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"]).alias("values"))
    return g.select(F.lit(kind).alias("kind"), (F.col("chunk") * size).alias("start"), F.size("values").cast("long").alias("count"), "values", F.sha2(F.to_json(F.struct("values")), 256).alias("checksum"))


def mesh_rows(chunks: DataFrame, kind: str, names: list[str]) -> DataFrame:
    """The rows of a kind: ``index`` and the named columns."""
    r = chunks.where(F.col("kind") == kind).select("start", F.posexplode("values").alias("k", "v"))
    return r.select((F.col("start") + F.col("k")).alias("index"), *[F.col("v")[n].alias(c) for n, c in enumerate(names)])


def write_mesh(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("errorifexists").partitionBy("kind").json(path)


def broken_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks whose values do not have their checksum or count."""
    return chunks.where((F.sha2(F.to_json(F.struct("values")), 256) != F.col("checksum")) | (F.size("values") != F.col("count")))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``ix, kind, props, geom_type, coordinates`` (JSON text) of every feature of every file."""
    f = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.posexplode("features").alias("ix", "f"))
    return f.select("ix", F.col("f.properties")["kind"].alias("kind"), F.col("f.properties").alias("props"), F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def rings(features: DataFrame) -> DataFrame:
    """``ix, ring, k, lng, lat`` of points, lines and polygons."""
    deep = F.from_json("coordinates", "array<array<array<double>>>")
    flat = F.array(F.from_json("coordinates", "array<array<double>>"))
    one = F.array(F.array(F.from_json("coordinates", "array<double>")))
    r = F.when(F.col("geom_type") == "Polygon", deep).when(F.col("geom_type") == "LineString", flat).when(F.col("geom_type") == "Point", one)
    return features.select("ix", F.posexplode(r).alias("ring", "points")).select("ix", "ring", F.posexplode("points").alias("k", "p")).select("ix", "ring", "k", F.col("p")[0].alias("lng"), F.col("p")[1].alias("lat"))


def closed_segments(points: DataFrame) -> DataFrame:
    """``feature, ring, ax, ay, bx, by`` from ring points, closing each ring."""
    w = W.partitionBy("ix", "ring").orderBy("k")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    return points.select(F.col("ix").alias("feature"), "ring", F.col("lng").alias("ax"), F.col("lat").alias("ay"), nxt("lng").alias("bx"), nxt("lat").alias("by")).where("ax <> bx or ay <> by")


def geojson_features(points: DataFrame) -> DataFrame:
    """``ix, feature`` (JSON text) from ``points(ix, kind, geom_type, ring, k, lng, lat)``; rings of polygons are closed."""
    rings_ = points.groupBy("ix", "kind", "geom_type", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "lng", "lat"))), lambda p: F.array(p["lng"], p["lat"])).alias("line"))
    ends_meet = F.element_at("line", 1) == F.element_at("line", -1)
    rings_ = rings_.withColumn("line", F.when((F.col("geom_type") == "Polygon") & ~ends_meet, F.concat("line", F.slice("line", 1, 1))).otherwise(F.col("line")))
    f = rings_.groupBy("ix", "kind", "geom_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "line"))), lambda r: r["line"]).alias("rings"))
    first = F.element_at("rings", 1)
    coordinates = F.when(F.col("geom_type") == "Polygon", F.to_json("rings")).when(F.col("geom_type") == "LineString", F.to_json(first)).otherwise(F.to_json(F.element_at(first, 1)))
    head = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("kind").alias("properties")))
    geometry = F.concat(F.lit(',"geometry":{"type":"'), "geom_type", F.lit('","coordinates":'), coordinates, F.lit("}}"))
    return f.withColumn("_h", head).withColumn("_g", geometry).select("ix", F.concat(F.expr("left(_h, length(_h) - 1)"), "_g").alias("feature"))


def write_geojson(points: DataFrame, path: str) -> None:
    """One GeoJSON feature a line below ``path``; refuses an existing target. :func:`read_features` reads it."""
    geojson_features(points).select(F.col("feature").alias("value")).write.mode("errorifexists").text(path)


def parsed_features(lines: DataFrame, text: str = "feature") -> DataFrame:
    """The columns of ``lines`` beside the text of a feature, and ``kind, props, geom_type, coordinates`` of it."""
    one = FEATURES.removeprefix("features array<").removesuffix(">")
    f = lines.withColumn("_f", F.from_json(text, one)).drop(text)
    return f.select("*", F.col("_f.properties")["kind"].alias("kind"), F.col("_f.properties").alias("props"), F.col("_f.geometry.type").alias("geom_type"), F.col("_f.geometry.coordinates").alias("coordinates")).drop("_f")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """``kind, props, geom_type, coordinates`` of line-wise features."""
    return parsed_features(spark.read.text(path), "value")


def read_field_archive(spark: SparkSession, path: str, ids: str = "case_ids", depth: str = "water_depth_m", u: str = "velocity_u_ms", v: str = "velocity_v_ms") -> DataFrame:
    """``path, case_id, cell_id, depth, u, v`` from numpy archives of case x cell arrays; one archive at a time in a task.

    An archive with other types or shapes than (cases, cells) of 64-bit floats fails the job.
    """

    def run(batches):
        for b in batches:
            for name, body in zip(b["path"], b["content"], strict=True):
                with np.load(io.BytesIO(bytes(body)), allow_pickle=False) as f:
                    cases, fields = f[ids].astype(str), [f[k] for k in (depth, u, v)]
                if any(x.dtype != np.float64 or x.ndim != 2 or x.shape != (len(cases), fields[0].shape[1]) for x in fields):
                    raise ValueError(f"{name}: the fields are not (cases, cells) of 64-bit floats")
                for k, case in enumerate(cases):
                    yield pd.DataFrame({"path": name, "case_id": case, "cell_id": np.arange(fields[0].shape[1]), "depth": fields[0][k], "u": fields[1][k], "v": fields[2][k]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, case_id string, cell_id long, depth double, u double, v double")


def field_problems(field: DataFrame) -> DataFrame:
    """One row ``n, cases, not_finite, negative_depth, uneven``: values that are not finite, depths below 0, cells that not every case has."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    cells = field.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad("depth") | bad("u") | bad("v")).alias("bad"), F.count_if(F.col("depth") < 0).alias("negative"))
    cases = field.agg(F.count_distinct("case_id").alias("cases"))
    r = cells.join(F.broadcast(cases)).agg(F.sum("n").alias("n"), F.max("cases").alias("cases"), F.sum("bad").alias("not_finite"), F.sum("negative").alias("negative_depth"), F.count_if(F.col("n") != F.col("cases")).alias("uneven"))
    return r.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in r.columns])


def mesh_row_problems(cells: DataFrame, vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``kind, index, problem`` of rows that break a rule.

    ``cells(index, a, b, c)``: repeated or unknown vertices; ``vertices(index, x, y)``:
    coordinates that are not finite; ``faces(index, a, b, left, right, length)``: equal
    ends, unknown vertices or cells (a null ``right`` is the boundary), lengths that are not positive.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    row = lambda d, kind, problem: d.select(F.lit(kind).alias("kind"), F.col("index").cast("long").alias("index"), F.lit(problem).alias("problem"))

    def unknown(d: DataFrame, kind: str, columns: list[str], there: DataFrame, what: str) -> DataFrame:
        used = d.select("index", F.explode(F.array(*[F.col(c).cast("long") for c in columns])).alias("ref")).where("ref is not null")
        return row(used.join(there.select(F.col("index").cast("long").alias("ref")), "ref", "left_anti").distinct(), kind, what)

    parts = [
        row(cells.where("a = b or b = c or a = c"), "cell", "repeated vertex"), unknown(cells, "cell", ["a", "b", "c"], vertices, "unknown vertex"),
        row(vertices.where(~(finite("x") & finite("y"))), "vertex", "not finite"), row(faces.where("a = b"), "face", "repeated vertex"),
        unknown(faces, "face", ["a", "b"], vertices, "unknown vertex"), unknown(faces, "face", ["left", "right"], cells, "unknown cell"), row(faces.where(~(finite("length") & (F.col("length") > 0))), "face", "length"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def packed_problems(parts: DataFrame, expected: DataFrame) -> DataFrame:
    """``archive, problem``: packed archives whose joined size or SHA-256 differs from ``expected(archive, size, sha256)``, and missing ones."""
    body = F.unbase64(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "part"))), lambda x: x["part"]), ""))
    whole = parts.groupBy("archive").agg(body.alias("body")).select("archive", F.octet_length("body").alias("n"), F.sha2("body", 256).alias("digest"))
    j = expected.select("archive", "size", "sha256").join(whole, "archive", "left")
    return j.select("archive", F.when(F.col("n").isNull(), "missing").when(F.col("n") != F.col("size"), "size").when(F.col("digest") != F.col("sha256"), "digest").alias("problem")).where("problem is not null")


def packed_arrays(parts: DataFrame, layout: list[tuple[str, str, int, int, int]]) -> DataFrame:
    """``name, row, col, value`` from gzip archives in base64 parts ``(archive, ix, part)``; layout rows are name, dtype, offset, rows, columns."""

    def run(batches):
        for b in batches:
            for text in b["body"]:
                raw = gzip.decompress(bytes(text))
                for name, kind, offset, n, m in layout:
                    v = np.frombuffer(raw, np.dtype(kind), n * m, offset).reshape(n, m)
                    i, j = np.indices(v.shape)
                    yield pd.DataFrame({"name": name, "row": i.ravel(), "col": j.ravel(), "value": v.ravel().astype(float)})

    whole = parts.groupBy("archive").agg(F.unbase64(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "part"))), lambda x: x["part"]), "")).alias("body"))
    return whole.select("body").mapInPandas(run, "name string, row long, col long, value double")


def station_series(payloads: DataFrame) -> DataFrame:
    """``station, obs_time, level, flag`` from JSON payloads with three lists of readings."""
    item = "array<struct<obsTime:string, stgCcd:string, stg:double, stgQmflg:string>>"
    p = F.from_json("payload", f"min10Values {item}, hrValues {item}, pastValues {item}")
    lists = F.concat(*[F.coalesce(p[c], F.array().cast(item)) for c in ("min10Values", "hrValues", "pastValues")])
    return payloads.select("station", F.explode(lists).alias("r")).select("station", F.col("r.obsTime").alias("obs_time"), F.col("r.stg").alias("level"), F.coalesce("r.stgCcd", "r.stgQmflg").alias("flag"))


def write_statistics(stats: DataFrame, summary: DataFrame, path: str) -> None:
    """The per-cell table as Parquet and the summary as JSON; refuses an existing target."""
    stats.write.mode("errorifexists").parquet(f"{path}/cells")
    summary.write.mode("errorifexists").json(f"{path}/summary")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, sha256`` of every file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """``path, problem``: missing, extra, size or digest."""
    r = recorded.select("path", F.col("size").alias("r_size"), F.col("sha256").alias("r_sha"))
    j = found.join(r, "path", "full_outer")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("r_sha").isNull(), "extra").when(F.col("size") != F.col("r_size"), "size").when(F.col("sha256") != F.col("r_sha"), "digest")
    return j.select("path", problem.alias("problem")).where("problem is not null")
