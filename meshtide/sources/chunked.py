"""Chunk files behind a manifest, as a Spark data source.

A manifest has one JSON object a line for each chunk file: ``kind, start, count,
url, bytes, sha256``. The source makes a partition of each chunk that is asked for.
Filters on ``kind`` and ``index`` are pushed down to the manifest, so that other
chunks are not opened; only the columns of the schema that the reader is given
are built. A chunk whose size, digest, kind, start or count differs from the
manifest, or whose values are no numbers, gives one row with a ``problem`` in place
of its rows, or fails the job if the option ``strict`` is true; so do starts that
leave a gap or overlap.

    spark.dataSource.register(ChunkSource)
    spark.read.format("meshtide_chunks").option("manifest", path).load().where("kind = 'triangle' and index < 100")

Schema: ``kind string, index long, values array<double>, problem string``; a schema
given by the user may take some of these, and doubles by other names are the
elements of ``values`` that the option ``fields`` names, in order.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "kind string, index long, values array<double>, problem string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def write_chunks(chunks: DataFrame, path: str) -> str:
    """Writes ``chunks(kind, start, count, values)`` as a JSON file each and a manifest beside them; returns the manifest's path.

    Refuses an existing target. Digests are those of the files as they are stored.
    """
    spark = chunks.sparkSession
    rows = chunks.select("kind", "start", F.to_json(F.struct("kind", "start", "count", "values")).alias("value"), F.col("kind").alias("_kind"), F.col("start").alias("_start"))
    rows.repartition("_kind", "_start").select("value", "_kind", "_start").write.mode("errorifexists").partitionBy("_kind", "_start").text(f"{path}/chunks")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/chunks")
    head = F.from_json(F.decode("content", "UTF-8"), "kind string, start long, count long")
    entries = files.select(head.alias("h"), F.col("path").alias("url"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    entries.select("h.*", "url", "bytes", "sha256").coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")  # a row for each chunk
    return f"{path}/manifest"


@dataclass
class Chunk(InputPartition):
    """A manifest's entry; ``order``: what is wrong with its place among the chunks of its kind, if anything."""

    kind: str
    start: int
    count: int
    url: str
    bytes: int
    sha256: str
    order: str | None = None


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "meshtide_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ChunkReader(schema, dict(self.options))


class ChunkReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.manifest, self.strict = options["manifest"], str(options.get("strict", "false")).lower() == "true"
        self.fields = [x.strip() for x in options.get("fields", "").split(",") if x.strip()]
        self.kinds: set[str] | None = None
        self.low, self.high = None, None  # of the index, both included

    def pushFilters(self, filters):
        """Kinds and bounds of the index choose chunks; bounds are left to Spark as well, since a chunk holds rows on both sides of them."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name == "kind" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.kinds = wanted if self.kinds is None else self.kinds & wanted
                continue
            if name == "index" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = f.value + isinstance(f, GreaterThan)
                    self.low = low if self.low is None else max(self.low, low)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = f.value - isinstance(f, LessThan)
                    self.high = high if self.high is None else min(self.high, high)
            yield f

    def partitions(self) -> list[Chunk]:
        disk, root = fs.FileSystem.from_uri(self.manifest)
        info = disk.get_file_info(root)
        files = [x.path for x in disk.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("part-")] if info.type == fs.FileType.Directory else [root]
        lines = [json.loads(line) for f in files for line in disk.open_input_file(f).read().decode().splitlines() if line]
        entries = sorted((Chunk(**{k: x[k] for k in ("kind", "start", "count", "url", "bytes", "sha256")}) for x in lines), key=lambda c: (c.kind, c.start))
        end: dict[str, int] = {}
        for c in entries:
            if c.start != end.get(c.kind, 0):
                c.order = f"starts at {c.start}, not at {end.get(c.kind, 0)}"
            end[c.kind] = c.start + c.count
        wanted = lambda c: (self.kinds is None or c.kind in self.kinds) and (self.low is None or c.start + c.count > self.low) and (self.high is None or c.start <= self.high)
        return [c for c in entries if wanted(c) or c.order and (self.kinds is None or c.kind in self.kinds)]

    def read(self, c: Chunk) -> Iterator[pa.RecordBatch]:
        values, problem = [], c.order
        if problem is None:
            values, problem = self.checked(c)
        if problem and self.strict:
            raise ValueError(f"{c.url}: {problem}")
        n = 1 if problem else len(values)
        columns = {"kind": lambda: [c.kind] * n, "index": lambda: [None] if problem else list(range(c.start, c.start + n)), "values": lambda: [None] if problem else values, "problem": lambda: [problem] * n}
        kinds = {"string": pa.string(), "bigint": pa.int64(), "array<double>": pa.list_(pa.float64()), "double": pa.float64()}
        arrays = []
        for name, kind in self.names:
            at = self.fields.index(name) if name in self.fields else None
            made = columns[name]() if at is None else [None] * n if problem else [v[at] if at < len(v) else None for v in values]
            arrays.append(pa.array(made, kinds[kind]))
        yield pa.RecordBatch.from_arrays(arrays, [name for name, _ in self.names])

    @staticmethod
    def checked(c: Chunk) -> tuple[list, str | None]:
        """The values of a chunk, or what is wrong with it."""
        try:
            disk, path = fs.FileSystem.from_uri(c.url)
            raw = disk.open_input_file(path).read()
        except OSError:
            return [], "missing"
        if len(raw) != c.bytes or hashlib.sha256(raw).hexdigest() != c.sha256:
            return [], "checksum"
        try:
            x = json.loads(raw)
            values = [[float(v) for v in row] for row in x["values"]]
        except (ValueError, KeyError, TypeError):
            return [], "no numbers"
        if (x.get("kind"), x.get("start")) != (c.kind, c.start):
            return [], "kind or start"
        return (values, None) if len(values) == c.count else ([], "count")


def read_chunks(spark: SparkSession, manifest: str, schema: str = SCHEMA, fields: list[str] | None = None, strict: bool = False) -> DataFrame:
    """The rows behind a manifest; see the module. Turns on the filters' pushdown for the session."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(ChunkSource)
    return spark.read.format("meshtide_chunks").schema(schema).option("manifest", manifest).option("fields", ",".join(fields or [])).option("strict", str(strict)).load()
