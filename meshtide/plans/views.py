"""Domain views of the given tables, each as a DataFrame and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtide.session import table


def field(spark: SparkSession, sf: str) -> DataFrame:
    """A dense case x cell matrix: case = vec_id, cell = position."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("case_id"), F.col("embedding").cast("array<double>").alias("e"))
    x = e.select("case_id", "e", F.posexplode("e").alias("cell_id", "u"))
    return x.select("case_id", "cell_id", F.abs("u").alias("depth"), "u", F.element_at("e", (F.col("cell_id") + 1) % F.size("e") + 1).alias("v"))


FIELD = "field AS (SELECT vec_id AS case_id, (i - 1)::INT AS cell_id, abs(embedding[i]::DOUBLE) AS depth, embedding[i]::DOUBLE AS u, embedding[i % len(embedding) + 1]::DOUBLE AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Readings: series = user, t in seconds, ordinal = event number, flag = event type."""
    return table(spark, sf, "events").select(F.col("user_id").alias("series_id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), "value", F.col("event_type").alias("flag"), F.col("event_id").alias("ordinal")).select("series_id", F.floor(F.col("us") / 1e6).cast("double").alias("t"), "value", "flag", "ordinal")


SERIES = "series AS (SELECT user_id AS series_id, floor(epoch_us(ts) / 1e6)::DOUBLE AS t, value, event_type AS flag, event_id AS ordinal FROM events)"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Run-length rows from line items, still overlapping."""
    return table(spark, sf, "lineitem").select((F.col("l_partkey") % 512).cast("int").alias("row"), (F.col("l_suppkey") * 7).cast("int").alias("x0"), (F.col("l_suppkey") * 7 + F.col("l_quantity") % 5).cast("int").alias("x1"), (F.col("l_linenumber") % 2).alias("half"))


RUNS = "runs AS (SELECT (l_partkey % 512)::INT AS row, (l_suppkey * 7)::INT AS x0, (l_suppkey * 7 + l_quantity % 5)::INT AS x1, l_linenumber % 2 AS half FROM lineitem)"
PIXELS = "pixels AS (SELECT DISTINCT row, half, unnest(range(x0, x1 + 1))::INT AS x FROM runs)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Scored points in metres: scene = event type."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("event_id") * 37 % 4001 / 4.0).alias("x"), (F.col("event_id") * 91 % 3989 / 4.0).alias("y"), F.least(F.lit(1.0), F.col("value") / 100).alias("score"), F.col("event_type").alias("scene"))


POINTS = "points AS (SELECT event_id AS id, event_id * 37 % 4001 / 4.0 AS x, event_id * 91 % 3989 / 4.0 AS y, least(1.0, value / 100) AS score, event_type AS scene FROM events)"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """A weighted graph: part to supplier (offset), a weight for each line item."""
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("edge_id"), F.col("l_partkey").alias("left"), (F.col("l_suppkey") + 1_000_000).alias("right"), F.col("l_quantity").alias("w"), "l_discount")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("node_id"), (F.col("p_retailprice") / 1000).alias("value"))
    return p.union(table(spark, sf, "supplier").select(F.col("s_suppkey") + 1_000_000, F.col("s_acctbal") / 1000))


GRAPH = """edges AS (SELECT l_orderkey * 8 + l_linenumber AS edge_id, l_partkey AS "left", l_suppkey + 1000000 AS "right", l_quantity AS w, l_discount FROM lineitem),
nodes AS (SELECT p_partkey AS node_id, p_retailprice / 1000 AS value FROM part UNION ALL SELECT s_suppkey + 1000000, s_acctbal / 1000 FROM supplier),
flux AS (SELECT edge_id, "left", "right", w * (a.value - b.value) AS f FROM edges LEFT JOIN nodes a ON a.node_id = "left" LEFT JOIN nodes b ON b.node_id = "right")"""


def mesh(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A strip of squares of two triangles each, one square for each customer."""
    c = table(spark, sf, "customer").select("c_custkey")
    k, n = F.col("c_custkey"), 50
    corner = F.floor(k / n) * (n + 1) + k % n
    tri = c.select(F.explode(F.array(F.struct((k * 2).alias("cell_id"), corner.alias("a"), (corner + 1).alias("b"), (corner + n + 2).alias("c")), F.struct((k * 2 + 1).alias("cell_id"), corner.alias("a"), (corner + n + 1).alias("b"), (corner + n + 2).alias("c")))).alias("t")).select("t.*")
    v = tri.select(F.explode(F.array("a", "b", "c")).alias("vertex_id")).distinct().select("vertex_id", (F.col("vertex_id") % (n + 1)).cast("double").alias("x"), (F.floor(F.col("vertex_id") / (n + 1)) * 1.5).cast("double").alias("y"))
    # Spark takes exploded rows to be as many as the customers and would broadcast them
    return tri.hint("merge"), v.hint("merge")


MESH = """corner AS (SELECT c_custkey AS k, c_custkey // 50 * 51 + c_custkey % 50 AS p FROM customer),
tri AS (SELECT k * 2 AS cell_id, p AS a, p + 1 AS b, p + 52 AS c FROM corner UNION ALL SELECT k * 2 + 1, p, p + 51, p + 52 FROM corner),
vert AS (SELECT DISTINCT v AS vertex_id, (v % 51)::DOUBLE AS x, (v // 51 * 1.5)::DOUBLE AS y FROM (SELECT unnest([a, b, c]) AS v FROM tri)),
halfedge AS (SELECT cell_id, least(p, q) AS lo, greatest(p, q) AS hi FROM (SELECT cell_id, a AS p, b AS q FROM tri UNION ALL SELECT cell_id, b, c FROM tri UNION ALL SELECT cell_id, c, a FROM tri)),
edge AS (SELECT lo, hi, min(cell_id) AS "left", CASE WHEN count(*) > 1 THEN max(cell_id) END AS "right", count(*) AS n FROM halfedge GROUP BY lo, hi)"""


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Case diagnostics from orders; run = priority."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("run_id"), F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"), (F.col("o_totalprice") / 1e5).alias("wall_s"), ((F.col("o_custkey") % 101 - 50) * 1e-10).alias("mass_error"), (F.col("o_custkey") % 97 / 100).alias("cfl"), (F.col("o_totalprice") / 1e6 - 0.001).alias("min_depth"))


CASES = "cases AS (SELECT o_orderpriority AS run_id, o_orderkey AS case_id, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status, o_totalprice / 1e5 AS wall_s, (o_custkey % 101 - 50) * 1e-10 AS mass_error, o_custkey % 97 / 100 AS cfl, o_totalprice / 1e6 - 0.001 AS min_depth FROM orders)"
