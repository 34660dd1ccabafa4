"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector v by ``floor((a.v + b) / w)`` for PROJECTIONS Gaussian
vectors a. A query visits its own bucket and perturbed ones, in the order of
their estimated success: perturbation sets are ranked once by the expected
squared distance to the bucket borders they cross, then mapped to each query's
own nearest borders. Candidates of all tables are merged and reranked by exact
distance.

Every row is indexed. The width w is WIDTH times the median distance of a
neighbour in a sample of at most SAMPLE rows, so where neighbours are near the
buckets are small. Queries are numbered in blocks of BLOCK; the buckets a block visits
are rows ``(table, key, block, which of its queries)`` that join the rows' keys
by equality, a bit-or merges the tables, and exact distances are computed for the
candidates of that join alone, in groups of about CHUNK rows. A bucket that holds
a third of all rows meets one row for each block that visits it: the visits are broadcast
up to BROADCAST_ROWS, else adaptive execution splits the rows' side.

Defined results: vectors that are null, zero, of another length than most or
hold null or non-finite components take no part, as queries or candidates; a repeated
row is a candidate as often as it stands there, and one query; rows with the query's
own id are left out; ties go to the smaller id; rows with null ids take no part; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtide.session import checkpointed, written

#: Tuned for recall of at least 0.9 at 10 neighbours; the width is a multiple of a sampled neighbour's distance.
TABLES, PROJECTIONS, WIDTH, PROBES = 24, 10, 1.75, 192
CHUNK, BLOCK, SEED, SAMPLE = 4096, 512, 11, 2000
#: Rows (some 90 bytes each) of visited buckets that may be broadcast.
BROADCAST_ROWS = 100_000
PAIRS = 1 << 15


def projections(dim: int, tables: int, count: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(dim, tables * count)), rng.uniform(0, width, tables * count)


def probing_order(count: int, probes: int) -> list[list[int]]:
    """Perturbation sets as ranks of the 2*count borders (nearest first), best estimated success first.

    The expected squared distance of the j-th nearest border, in bucket widths:
    j(j+1)/(4(M+1)(M+2)) up to M, and by symmetry beyond. A set may not cross
    both borders of one projection; those have ranks j and 2M-1-j.
    """
    m = count
    cost = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    cost += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    out, heap = [[]], [(cost[0], [0])]
    while heap and len(out) < probes:
        at, s = heapq.heappop(heap)
        if not any(2 * m - 1 - j in s for j in s):
            out.append(s)
        last = s[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (at - cost[last] + cost[last + 1], [*s[:-1], last + 1]))
            heapq.heappush(heap, (at + cost[last + 1], [*s, last + 1]))
    return out


def mixed_key(cells: np.ndarray) -> np.ndarray:
    """One 64-bit key for each vector of bucket numbers on the last axis."""
    key = np.zeros(cells.shape[:-1], np.uint64)
    for k in range(cells.shape[-1]):
        key = (key ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def row_keys(v: np.ndarray, a: np.ndarray, b: np.ndarray, tables: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys (n, tables) and positions inside the buckets (n, tables, projections)."""
    x = ((v @ a + b) / width).reshape(len(v), tables, -1)
    cell = np.floor(x)
    return mixed_key(cell), x - cell


def probe_keys(v: np.ndarray, a: np.ndarray, b: np.ndarray, tables: int, width: float, order: list[list[int]]) -> np.ndarray:
    """Keys (n, tables, probes) of the buckets each query visits."""
    x = ((v @ a + b) / width).reshape(len(v), tables, -1)
    cell = np.floor(x)
    inside = x - cell
    m = x.shape[-1]
    borders = np.argsort(np.concatenate([inside, 1 - inside], axis=-1), axis=-1, kind="stable")
    keys = np.empty((*cell.shape[:2], len(order)), np.uint64)
    for p, ranks in enumerate(order):
        c = cell.copy()
        for r in ranks:
            which = borders[..., r]
            np.put_along_axis(c, (which % m)[..., None], np.take_along_axis(c, (which % m)[..., None], -1) + np.where(which < m, -1, 1)[..., None], -1)
        keys[..., p] = mixed_key(c)
    return keys


def visits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of one table's probes (queries, probes), and a bit for each query that visits them, in 64-bit words."""
    names, at = np.unique(keys, return_inverse=True)
    words = np.zeros((len(names), BLOCK // 64), np.uint64)
    query = np.repeat(np.arange(len(keys)), keys.shape[1])
    np.bitwise_or.at(words, (at.ravel(), query >> 6), np.uint64(1) << (query & 63).astype(np.uint64))
    return names, words


def best(q_id, q, v_id, v, words, k: int):
    """Of each query's candidates (bits of ``words``) the k nearest by exact distance: query number, row id, distance."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(v), -1), axis=1, bitorder="little")
    j, i = np.nonzero(bits)
    own = q_id[i] == v_id[j]
    i, j = i[~own], j[~own]
    d = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        s = slice(at, at + PAIRS)
        d[s] = np.sqrt(((q[i[s]] - v[j[s]]) ** 2).sum(axis=1))
    order = np.lexsort((v_id[j], d, i))
    i, j, d = i[order], j[order], d[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], v_id[j[keep]], d[keep]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the vectors that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def fitted_width(rows: DataFrame, k: int, ratio: float) -> float:
    """``ratio`` times the median distance of the k-th neighbour among at most SAMPLE rows, chosen by a hash of id and vector."""
    v = np.array([r["v"] for r in rows.select("v").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).collect()])
    if len(v) < 2:
        return 1.0
    far = np.sqrt(np.maximum(0, (v * v).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * v @ v.T))
    far = np.sort(far, axis=1)[:, 1 : k + 1]
    near = float(np.median(far[:, -1]))
    return ratio * (near if near > 0 else float(far.max()) or 1.0)


def blocks(queries: DataFrame) -> DataFrame:
    """``block, ids, vectors``: up to BLOCK queries in one row, as raw numbers."""

    def run(batches):
        base, n = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([ids.tobytes()]), pa.array([flat.tobytes()])], ["block", "ids", "vectors"])
                n += 1

    return queries.select("vec_id", "v").mapInArrow(run, "block long, ids binary, vectors binary")


WORDS = [f"w{k}" for k in range(BLOCK // 64)]


def candidates(rows: DataFrame, packed: DataFrame, width: float, tables: int, count: int, probes: int, seed: int) -> DataFrame:
    """``rid, block, w0..``: for each row and block the queries that visit one of the row's buckets, as bits."""
    order = probing_order(count, probes)

    def row_side(batches):
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            a, c = projections(v.shape[1], tables, count, width, seed)
            keys, _ = row_keys(v, a, c, tables, width)
            rid = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rid, tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(v))), pa.array(keys.view(np.int64).ravel())], ["rid", "table", "key"])

    def query_side(batches):
        for b in batches:
            for row in b.to_pylist():
                v = np.frombuffer(row["vectors"]).reshape(len(row["ids"]) // 8, -1)
                a, c = projections(v.shape[1], tables, count, width, seed)
                keys = probe_keys(v, a, c, tables, width, order)
                for t in range(tables):
                    names, words = visits(keys[:, t])
                    n = len(names)
                    columns = [pa.array(np.full(n, t, np.int32)), pa.array(names.view(np.int64)), pa.array(np.full(n, row["block"], np.int64)), *(pa.array(np.ascontiguousarray(w).view(np.int64)) for w in words.T)]
                    yield pa.RecordBatch.from_arrays(columns, ["table", "key", "block", *WORDS])

    keyed = rows.select("rid", "v").where(F.size("v") > 0).mapInArrow(row_side, "rid long, table int, key long")
    visited = checkpointed(packed.mapInArrow(query_side, f"table int, key long, block long, {', '.join(f'{w} long' for w in WORDS)}"))
    few = visited.count() <= BROADCAST_ROWS
    hits = keyed.join(F.broadcast(visited) if few else visited, ["table", "key"])
    return hits.groupBy("rid", "block").agg(*(F.bit_or(w).alias(w) for w in WORDS))


def nearest(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, count: int = PROJECTIONS, width: float = WIDTH, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row for which ``is_query`` (a condition on ``vec_id``) holds."""
    rows = written(usable(df, id_col, vector_col).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    queries = rows.where(is_query).dropDuplicates(["vec_id", "v"])
    packed = checkpointed(blocks(queries.repartition(-(-queries.count() // BLOCK) or 1)))  # full blocks, however the table is dealt
    found = checkpointed(candidates(rows, packed, fitted_width(rows, k, width), tables, count, probes, seed))
    salts = -(-rows.count() // CHUNK) or 1
    dealt = found.join(rows, "rid").select("block", F.pmod(F.xxhash64("rid"), F.lit(salts)).alias("salt"), "vec_id", "v", *WORDS)
    there = found.select("block", F.pmod(F.xxhash64("rid"), F.lit(salts)).alias("at_salt")).distinct().join(packed, "block").withColumnRenamed("block", "at_block")

    def rerank(key, left, right):
        left = left.combine_chunks()
        q_id, v_id = np.frombuffer(right["ids"][0].as_py(), "<i8"), left["vec_id"].to_numpy()
        q = np.frombuffer(right["vectors"][0].as_py()).reshape(len(q_id), -1)
        v = pa.concat_arrays(left["v"].chunks).flatten().to_numpy(zero_copy_only=False).reshape(len(v_id), -1)
        words = np.stack([left[w].to_numpy() for w in WORDS], axis=1)
        at, near, score = best(q_id, q, v_id, v, words, k)
        return pa.table({"block": np.full(len(at), key[0].as_py(), np.int64), "number": at, "query_id": q_id[at], "vec_id": near, "score": score})

    pairs = dealt.groupBy("block", "salt").cogroup(there.groupBy("at_block", "at_salt"))
    near = pairs.applyInArrow(rerank, "block long, number long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("block", "number").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
