"""Packing token sequences: shortest-pack-first over the length histogram, and best-fit-decreasing output.

``histogram_packs`` (shortest-pack-first): documents are cut into pieces of the
pack length and a rest; only the histogram of piece lengths (at most one row
for each length up to the pack length, whatever the input) reaches the driver.
Lengths are placed longest first, each into the pack with fewest tokens, by
updating counts of packing patterns; patterns are then joined back to the pieces
by their rank among pieces of the same length. Ranks come from buckets of about
RANK_BUCKET pieces, so a length shared by a third of all pieces is spread too.

``binary_packs`` (best-fit-decreasing): each task packs the documents it reads
in batches of at most BATCH_TOKENS tokens, largest piece first into the pack with
the least room that still fits, found in a segment tree over capacities. No row
moves between tasks.

Defined results for both: null text counts as empty; an empty text is one piece
holding the ending id alone; texts of any length are cut without loss; repeated
rows and null ids are packed like any others; ties go by id and start; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meshtide.llm.tokens import RANKS, VOCABULARY, ids
from meshtide.session import checkpointed

CAPACITY, RANK_BUCKET, BATCH_TOKENS = 2048, 512, 1 << 21


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: each document in pieces of ``capacity`` and a rest."""

    def run(batches):
        for b in batches:
            rows = ([], [], [], [], [])
            at = []
            for n, text in enumerate(b.column(1)):
                t = ids(text.as_py(), vocabulary, ranks)
                for s in range(0, len(t), capacity):
                    part = t[s : s + capacity]
                    at.append(n)
                    for column, v in zip(rows, (s, len(part), zlib.crc32(part.tobytes()), len(t)), strict=False):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(r, pa.int64()) for r in rows[:4])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (piece lengths in a pack) and how many packs follow each.

    Lengths are placed longest first, each into the packs that hold fewest
    tokens so far; what does not fit there opens packs of its own, filled with
    as many of that length as they hold.
    """
    open_packs: list[tuple[int, int, tuple[int, ...], int]] = []  # tokens, order, pattern, count
    order = 0

    def put(used: int, pattern: tuple[int, ...], count: int) -> None:
        nonlocal order
        if count:
            heapq.heappush(open_packs, (used, order, pattern, count))
            order += 1

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_packs and open_packs[0][0] + length <= capacity:
                used, _, pattern, count = heapq.heappop(open_packs)
                here = min(count, left)
                put(used, pattern, count - here)
                put(used + length, (*pattern, length), here)
                left -= here
            else:
                each = capacity // length
                put(each * length, (length,) * each, left // each)
                put(left % each * length, (length,) * (left % each), int(left % each > 0))
                left = 0
    return sorted(((p, n) for _, _, p, n in open_packs), key=lambda x: x[0], reverse=True)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``length, low, high, first sequence, offset``: which ranks of a length go to which sequences, and where."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            low = taken.get(length, 0)
            rows.append((length, low, low + count, first, offset))
            taken[length] = low + count
            offset += length
        first += count
    return rows


def ranked(parts: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds ``rank`` (from 0) among the pieces of the same length, by buckets.

    ``parts`` is checkpointed, so its row numbers are stable: they keep rows that repeat out of one bucket.
    """
    spark = parts.sparkSession
    buckets = spark.createDataFrame([(k, -(-n // RANK_BUCKET)) for k, n in histogram.items()], "length long, buckets long")
    dealt = parts.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.col("buckets"))).drop("buckets")
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    inside = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    return dealt.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside") - 1).drop("before", "inside", "bucket")


def histogram_packs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for every piece."""
    parts = checkpointed(pieces(docs, id_col, text_col, capacity, vocabulary, ranks))
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    places = slots(shortest_pack_first(histogram, capacity))
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(places, "length long, low long, high long, first long, offset long"))  # bounded by the capacity
    r = ranked(parts, histogram)
    placed = r.join(table, (r["length"] == table["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(table["length"])
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


class CapacityTree:
    """Counts of open packs by room left; finds the least room that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, need: int) -> int:
        """The smallest room >= need that some pack has, or -1."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1 and (i & 1 or not self.count[i + 1]):
            i >>= 1
        if i <= 1:
            return -1
        i += 1
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.size


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Packs of item numbers, best fit, longest first (ties by number)."""
    tree, rooms, packs = CapacityTree(capacity), [[] for _ in range(capacity + 1)], []
    for k in np.lexsort((np.arange(len(lengths)), -lengths)):
        need = int(lengths[k])
        room = tree.least(need)
        if room < 0:
            room, pack = capacity, len(packs)
            packs.append([])
        else:
            pack = rooms[room].pop()
            tree.add(room, -1)
        packs[pack].append(int(k))
        rooms[room - need].append(pack)
        tree.add(room - need, 1)
    return packs


def binary_packs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, pad: int = 0, batch_tokens: int = BATCH_TOKENS, vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> DataFrame:
    """One row for each packed sequence.

    ``input_ids`` (binary: ``capacity`` little-endian unsigned 32-bit ids, padded
    with ``pad``), ``n_tokens``, ``cu_seqlens`` (cumulative segment lengths from
    0), ``position_ids`` (binary, same layout; starts again at 0 in each segment
    and in the padding), ``doc_ids`` and ``starts`` of the segments.
    """

    def packed(names, tokens):
        owner, begin, parts = [], [], []
        for n, t in enumerate(tokens):
            for s in range(0, len(t), capacity):
                owner.append(n)
                begin.append(s)
                parts.append(t[s : s + capacity])
        out = {k: [] for k in ("input_ids", "n_tokens", "cu_seqlens", "position_ids", "doc_ids", "starts")}
        for pack in best_fit(np.array([len(p) for p in parts], np.int64), capacity):
            sizes = [len(parts[k]) for k in pack]
            row, pos = np.full(capacity, pad, "<u4"), np.zeros(capacity, "<u4")
            ends = np.cumsum(sizes)
            row[: ends[-1]] = np.concatenate([parts[k] for k in pack])
            for e, n in zip([*ends, capacity], [*sizes, capacity - ends[-1]], strict=True):
                pos[e - n : e] = np.arange(n)
            for name, v in zip(out, (row.tobytes(), int(ends[-1]), [0, *ends.tolist()], pos.tobytes(), [names[owner[k]] for k in pack], [begin[k] for k in pack]), strict=True):
                out[name].append(v)
        return pa.RecordBatch.from_pydict(out, schema=schema)

    def run(batches):
        names, tokens, held = [], [], 0
        for b in batches:
            for name, text in zip(b.column(0), b.column(1), strict=True):
                names.append(name.as_py())
                tokens.append(ids(text.as_py(), vocabulary, ranks))
                held += len(tokens[-1])
                if held >= batch_tokens:
                    yield packed(names, tokens)
                    names, tokens, held = [], [], 0
        if names:
            yield packed(names, tokens)

    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    arrow = to_arrow_type(rows.schema["doc_id"].dataType)
    schema = pa.schema([("input_ids", pa.binary()), ("n_tokens", pa.int64()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("doc_ids", pa.list_(arrow)), ("starts", pa.list_(pa.int64()))])
    return rows.mapInArrow(run, f"input_ids binary, n_tokens long, cu_seqlens array<int>, position_ids binary, doc_ids array<{kind}>, starts array<long>")


def write_packs(packs: DataFrame, path: str) -> None:
    """Writes what :func:`binary_packs` returns as Parquet: one row a sequence, ids and positions as raw numbers."""
    packs.write.mode("errorifexists").parquet(path)


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_packs` wrote; :func:`matrix` turns a batch of it into arrays."""
    return spark.read.parquet(path)


def matrix(rows, column: str = "input_ids") -> np.ndarray:
    """The (rows, capacity) matrix of a binary column of collected rows."""
    return np.stack([np.frombuffer(r[column], "<u4") for r in rows]) if rows else np.zeros((0, 0), "<u4")
