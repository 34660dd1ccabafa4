"""WARC archives: written with an index of byte ranges, read back by it.

Writing: each task streams its pages into gzip archives in a shared folder, a
gzip member for each record, and returns a row for each record: file, offset,
length, URL, digest. Those rows are the index, a Parquet table. Reading goes by
the index alone: the wanted rows are sorted by file and offset, neighbours that
lie close are fetched by one ranged read, and members are cut out of the bytes
read. Nothing scans an archive.

Pages whose payloads are equal are stored once: the one with the largest id as
``response``, the others as ``revisit`` records, which hold the headers alone.
The pages themselves are not shuffled for it unless the table of repeated
payloads is too large to be broadcast (Spark decides by its files' size); then a
payload's rows are dealt to SALTS tasks.

A file's name is new for every attempt of a task, and the index names only files
of attempts that ended, so lost executors leave files that nobody reads, at worst.

Defined results: null html is an empty payload; a null or blank URL leaves out the
header, control characters and spaces in it are percent-encoded there and stay as
they are in the index; of equal payloads all rows with the largest id are
responses (repeated rows), null ids come last; an empty table gives an empty
index; other columns are not looked at. A payload is held whole in one task.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.session import shared_dir, written

#: An archive is closed when it has grown beyond so many bytes.
ARCHIVE_BYTES = 128 << 20
#: Ranges of one file that are no further apart are read at once, up to so many bytes; rows of a file are dealt by stretches of it.
GAP, READ_BYTES, STRETCH = 64 << 10, 4 << 20, 16 << 20
#: Tasks to which the rows of one repeated payload are dealt.
SALTS = 16
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "id {kind}, url string, payload_digest string, record_type string, file string, offset long, length long"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, fields: Iterable[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member of its own; fields without a value are left out."""
    head = [("WARC-Type", kind), *((k, v) for k, v in fields if v), ("Content-Length", str(len(block)))]
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(raw.encode() + block + b"\r\n\r\n") + press.flush()


def header_url(url: str | None) -> str | None:
    """A URL that fits on a header's line."""
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url.strip()) if url else None


def page_urn(page) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


class Archives:
    """Files of one task, each begun when the one before is full."""

    def __init__(self, folder: str, limit: int):
        self.disk, self.folder = fs.FileSystem.from_uri(folder)
        self.limit, self.out, self.name, self.at = limit, None, "", 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        """File, offset and length of what was written."""
        if self.out is None or self.at >= self.limit:
            self.close()
            self.disk.create_dir(self.folder, recursive=True)
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.out, self.at = self.disk.open_output_stream(f"{self.folder}/{self.name}", compression=None), 0
            self._write(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        at = self.at
        self._write(data)
        return self.name, at, len(data)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def repeated_payloads(keyed: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``key, salt, original, many`` of each payload of at least ``min_bytes`` that several of ``keyed(id, key, bytes)`` have; a row for each salt."""
    groups = keyed.where(F.col("bytes") >= min_bytes).groupBy("key").agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("many")).where("many > 1")
    return groups.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "original")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Writes the pages and returns the archives' folder and their index ``id, url, payload_digest, record_type, file, offset, length``."""
    spark = pages.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()

    html = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("payload"), F.unhex(F.sha2(html, 256)).alias("key"), F.length(html).alias("bytes"))
    again = written(repeated_payloads(rows.select("id", "key", "bytes"), min_bytes), "repeated")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url", F.spark_partition_id()), F.lit(SALTS)).cast("int"))
    decided = salted.join(again, ["key", "salt"], "left").select("id", "url", "payload", "original", (F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original"))).alias("revisit"))

    def run(batches):
        files = Archives(folder, archive_bytes)
        for b in batches:
            found = []
            for page, url, payload, original, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                digest = sha1_base32(payload)
                kind, block = ("revisit", b"") if revisit else ("response", payload)
                fields = [
                    ("WARC-Record-ID", page_urn(page)), ("WARC-Date", DATE), ("WARC-Target-URI", header_url(url)), ("WARC-Payload-Digest", f"sha1:{digest}"),
                    ("WARC-Refers-To", page_urn(original) if revisit else None), ("WARC-Profile", PROFILE if revisit else None), ("Content-Type", "application/http; msgtype=response"),
                ]
                found.append((digest, kind, *files.add(record(kind, fields, HTTP.format(len(payload)).encode() + block))))
            digest, kind, name, start, size = zip(*found, strict=True) if found else ((),) * 5
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (digest, kind, name, start, size))], ["id", "url", "payload_digest", "record_type", "file", "offset", "length"])
        files.close()

    kind = rows.schema["id"].dataType.simpleString()
    return folder, written(decided.mapInArrow(run, INDEX.format(kind=kind)), "warc-index")


def ranges(rows: Iterable[tuple], gap: int = GAP, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int, int]]]]:
    """``(file, start, end, [(row, offset, length)])``: each a read, from ``(file, offset, length)`` in order of file and offset."""
    file, start, end, members = None, 0, 0, []
    for k, (name, at, size) in enumerate(rows):
        if members and (name != file or at - end > gap or at + size - start > most):
            yield file, start, end, members
            members = []
        if not members:
            file, start, end = name, at, at
        members.append((k, at, size))
        end = max(end, at + size)
    if members:
        yield file, start, end, members


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields (names in lower case) and payload of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block, end = rest[: int(fields["content-length"])], rest[int(fields["content-length"]) :]
    if not head.startswith(b"WARC/1.") or end != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_records(folder: str, index: DataFrame, gap: int = GAP, most: int = READ_BYTES, stretch: int = STRETCH) -> DataFrame:
    """The records of the ``index`` rows: ``page string, target, record_type, payload_digest, payload_bytes, refers_to string, payload binary, intact, reads``.

    ``payload`` is null for revisits; ``payload_bytes`` is that of the full payload
    in any case. ``intact``: the payload has its digest and its length (a revisit:
    both are stated). ``reads`` is 1 for the first record of each ranged read, so
    that their sum counts the reads.
    """

    def run(batches):
        disk, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            rows, name, source = [], None, None
            places = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            for file, start, end, members in ranges(places, gap, most):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, disk.open_input_file(f"{root}/{file}")
                data = source.read_at(end - start, start)
                for n, (_, at, size) in enumerate(members):
                    warc, http, payload = parsed(data[at - start : at - start + size])
                    digest, full = warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                    whole = warc["warc-type"] == "response"
                    rows.append((warc["warc-record-id"][len("<urn:page:") : -1], warc.get("warc-target-uri"), warc["warc-type"], digest, full,
                                 warc["warc-refers-to"][len("<urn:page:") : -1] if "warc-refers-to" in warc else None,
                                 payload if whole else None, not whole or (sha1_base32(payload) == digest and len(payload) == full), int(n == 0)))
            if source is not None:
                source.close()
            if rows:
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.int32())
                names = ["page", "target", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload", "intact", "reads"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    spark = index.sparkSession
    stored = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-stored // stretch))  # by what is read, not by the index's own few bytes
    dealt = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / stretch)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "page string, target string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary, intact boolean, reads int")
