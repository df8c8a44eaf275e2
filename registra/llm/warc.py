"""WARC archives: a writer made of Spark's text sink, and a Python data source that reads them back.

A record of text ends with two line breaks, and so does a row of the text sink when that is its line separator: the sink
therefore writes valid WARC files with Spark's own commit protocol, on any file system that Spark can write to.

The reader plans partitions from the list of files, takes over predicates on record types and header fields, parses each
record's header first and steps over the blocks of records that no one asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from .common import settle, shared_folder, table

END = "\r\n\r\n"
LEAST = 1000  #: bytes from which equal payloads are stored once
#: column -> header field
FIELDS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "refers_to_record": "warc-refers-to",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
    "page_id": "x-page-id",
    "refers_to": "x-refers-to-page",
    "payload_length": "x-payload-length",
}
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in FIELDS] + [T.StructField("content_length", T.LongType()), T.StructField("file", T.StringType())])


# ---------------------------------------------------------------- writing


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", page.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, i, n), F.lit("-"))][:-1], F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; line breaks in a value become blanks."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]", " "), F.lit("\r\n")), F.lit(""))


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, body, digest, n, refers_to): which pages are stored and which revisit another page's record.

    Of equal payloads of at least 1000 bytes the one with the largest page_id is stored, the others refer to it; rows that
    share that page_id are all stored. Null html is an empty payload; a null page_id comes before all others. Only
    payloads that occur more than once are joined back; their list is a written table, so that Spark
    knows its size: small ones are broadcast, others take a shuffled join that splits frequent payloads.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha1(F.col("body").cast("binary"))).withColumn("n", F.octet_length("body").cast("long"))
    again = rows.filter(F.col("n") >= LEAST).groupBy("digest", "n").agg(F.max("page_id").alias("kept"), F.count("*").alias("copies")).filter("copies > 1")
    again = settle(again.select("digest", "n", "kept"))
    rows = rows.join(again, ["digest", "n"], "left")
    other = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return rows.select("page_id", "url", "body", "digest", "n", F.when(other, F.col("kept")).alias("refers_to"))


def write_warc(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Writes what ``plan_records`` returns, a response or revisit record for each row."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        _field("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), F.col("digest")))),
        _field("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _field("Content-Type", F.lit("application/http;msgtype=response")),
        _field("X-Page-Id", F.col("page_id")),
        _field("X-Refers-To-Page", F.col("refers_to")),
        _field("X-Payload-Length", F.col("n")),
        _field("Content-Length", F.octet_length(F.col("block"))),
        F.lit("\r\n"),
    )
    out = records.withColumn("block", block).select(F.concat(header, "block").alias("value"))
    out.write.option("lineSep", END).option("compression", compression).text(path)


# ---------------------------------------------------------------- reading


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Stream:
    """A buffered reader with the two moves that records need: up to a mark, and n bytes (kept or stepped over)."""

    STEP = 1 << 20

    def __init__(self, source, seekable: bool = False) -> None:
        self.source, self.held, self.seekable = source, b"", seekable

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            more = self.source.read(self.STEP)
            if not more:
                if self.held.strip():
                    raise ValueError("an archive ends within a record's header")
                return None
            self.held += more
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        if len(self.held) < n:
            parts, have = [self.held], len(self.held)
            while have < n:
                more = self.source.read(max(n - have, self.STEP))
                if not more:
                    raise ValueError("an archive ends within a record")
                parts.append(more)
                have += len(more)
            self.held = b"".join(parts)
        out, self.held = self.held[:n], self.held[n:]
        return out

    def skip(self, n: int) -> None:
        """Moves on by n bytes: in an uncompressed archive without reading them."""
        if n > len(self.held) and self.seekable:
            at = self.source.tell() + n - len(self.held)
            if at > self.source.size():
                raise ValueError("an archive ends within a record")
            self.source.seek(at)
            self.held = b""
            return
        while n > len(self.held):
            n -= len(self.held)
            self.held = self.source.read(self.STEP)
            if not self.held:
                raise ValueError("an archive ends within a record")
        self.held = self.held[n:]


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _test(f: Filter):
    """The predicate on header fields, or None where it is left to Spark."""
    name = f.attribute[0] if len(f.attribute) == 1 else None
    if name not in FIELDS:
        return None
    key = FIELDS[name]
    if isinstance(f, EqualTo):
        return lambda h: h.get(key) == f.value
    if isinstance(f, In):
        return lambda h: h.get(key) in f.value
    if isinstance(f, IsNotNull):
        return lambda h: key in h
    if isinstance(f, StringStartsWith):
        return lambda h: h.get(key, "").startswith(f.value) and key in h
    return None


class WarcFiles(InputPartition):
    def __init__(self, files: list[str]) -> None:
        super().__init__(files)


class WarcReader(DataSourceReader):
    BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.path = schema, options["path"]
        self.most = int(options.get("maxpartitionbytes", 64 << 20))
        self.tasks = int(options.get("tasks", 1))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if hasattr(f, "attribute") and _test(f) is not None:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[WarcFiles]:
        """Files in order, small ones together up to the wished size, or less where that leaves tasks without work; a file is never split."""
        from pyarrow import fs

        system, root = _file_system(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")) and x.size)
        most = min(self.most, sum(size for _, size in files) // self.tasks + 1)
        parts: list[list[str]] = []
        room = 0
        for name, size in files:
            if not parts or size > room:
                parts.append([])
                room = most
            parts[-1].append(name)
            room -= size
        return [WarcFiles(x) for x in parts]

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.path)
        tests, payload = [_test(f) for f in self.filters], "payload" in self.schema.fieldNames()
        types = pa.schema([(f.name, {"long": pa.int64(), "binary": pa.binary()}.get(f.dataType.typeName(), pa.string())) for f in self.schema])
        rows: list[dict] = []
        held = 0
        for name in partition.value:
            packed = name.endswith(".gz")
            with system.open_input_stream(name, compression="gzip") if packed else system.open_input_file(name) as source:
                stream = _Stream(source, seekable=not packed)
                while (raw := stream.until(b"\r\n\r\n")) is not None:
                    h = _headers(raw.lstrip(b"\r\n"))
                    n = int(h["content-length"])
                    if not all(t(h) for t in tests):
                        stream.skip(n + 4)
                        continue
                    row = {c: h.get(k) for c, k in FIELDS.items()} | {"content_length": n, "file": name}
                    if payload and h.get("warc-type") != "revisit":
                        block = stream.take(n)
                        row["payload"] = block.partition(b"\r\n\r\n")[2] if "application/http" in h.get("content-type", "") else block
                        stream.skip(4)
                        held += n
                    else:
                        stream.skip(n + 4)
                    rows.append(row)
                    if len(rows) >= self.BATCH_ROWS or held >= self.BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, types)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, types)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; option payload=true adds the decoded payloads as ``payload`` binary.

    A record that lacks a header field has null there; revisit records have a null payload. Broken archives raise an error.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        wanted = str(self.options.get("payload", "false")).lower() == "true"
        return T.StructType([*SCHEMA.fields, *([T.StructField("payload", T.BinaryType())] if wanted else [])])

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: bool = False, where: Column | str | None = None) -> DataFrame:
    """Records of the archives below ``path``; ``where`` on record types or header fields is applied while headers are parsed.

    Call it anew for each predicate: Spark 4.1 keeps the predicates that a Python source took over with the loaded table, so
    a second, different filter on one loaded DataFrame would see the first one's rows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    records = spark.read.format("warc").option("payload", str(payload).lower()).option("tasks", spark.sparkContext.defaultParallelism).load(path)
    return records if where is None else records.filter(where)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; lengths and digests of stored pages are taken from what was read."""
    path = f"{shared_folder(spark)}/warc"
    write_warc(plan_records(table(spark, sf_dir, "pages")), path)
    records = read_warc(spark, path, payload=True)
    stored = F.col("record_type") == "response"
    return records.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length").cast("long")).alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS digest FROM p),
     k AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS kept FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM k
"""
