"""WARC archives: writing, reading, and the resolution of revisits.

Headers (id, digest, length) are shuffled by payload digest; of equal payloads the one of the largest id is kept as
response and the others become revisit records, without a payload, that refer to it. Archives are written by Spark's text
writer with the record separator of the format, so they go to any file system that Spark writes and a lost task leaves
no half file. Reading parses them by their content lengths and joins revisits to their responses again.

Defined results: a null payload is an empty one; null ids and urls have no header and read back as null; rows that repeat
an id and a payload are records of their own, all responses if the id is the largest; line breaks in a url are
escaped; an empty table makes an archive without records, which reads back empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, materialise, scratch_path

# Fixed values of the format.
_VERSION, _BREAK = "WARC/1.1", "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: Records and bytes of an archive file at most (one record may be larger): a file is read by one task.
RECORDS_PER_FILE, BYTES_PER_FILE = 5_000, 256 << 20


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]", "%0A"), F.lit(_BREAK)), F.lit(""))


def find_revisits(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", payload: str = "html") -> DataFrame:
    """``digest, original`` for each payload of ``least_bytes`` or more that several rows with an id share: the largest of their ids."""
    digest = F.sha1(F.coalesce(F.col(payload), F.lit("")).cast("binary"))
    heads = materialise(pages.select(F.col(id_col).alias("id"), digest.alias("digest"), F.coalesce(F.octet_length(payload), F.lit(0)).alias("bytes")), "warc-heads")
    return (
        heads.filter((F.col("bytes") >= least_bytes) & F.col("id").isNotNull())
        .groupBy("digest")
        .agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("_k"))
        .filter("_k > 1")
        .select("digest", "original")
    )


def archive(
    pages: DataFrame, path: str | None = None, least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url: str = "url", payload: str = "html"
) -> str:
    """Write one record a row as gzip-compressed archives under ``path`` (a new one in the shared folder by default), and return it."""
    path = path or scratch_path(pages.sparkSession, "warc")
    text = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), text.alias("text")).withColumn("digest", F.sha1(F.col("text").cast("binary")))
    rows = lookup(rows, find_revisits(pages, least_bytes, id_col, payload), "digest")
    # the original is looked up by digest alone; payloads below the limit have none
    revisit = F.col("original").isNotNull() & F.col("id").isNotNull() & (F.col("id") != F.col("original"))
    http = F.concat(F.lit(_HTTP + "Content-Length: "), F.octet_length("text").cast("string"), F.lit(_BREAK + _BREAK))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("text")))
    head = F.concat(
        F.lit(_VERSION + _BREAK),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", _record_id(F.col("id"), F.col("digest"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        _header("WARC-Refers-To", F.when(revisit, _record_id(F.col("original"), F.col("digest")))),
        _header("X-Page-Id", F.col("id")),
        _header("X-Refers-To-Page-Id", F.when(revisit, F.col("original"))),
        F.lit("Content-Type: application/http;msgtype=response" + _BREAK),
        _header("Content-Length", F.octet_length(block)),
        F.lit(_BREAK),
    )
    writer = rows.select(F.concat(head, block).alias("value")).write.option("lineSep", _BREAK + _BREAK)
    largest = pages.agg(F.max(F.octet_length(payload))).first()[0] or 0
    most = max(1, min(RECORDS_PER_FILE, BYTES_PER_FILE // (largest + 1000)))
    writer.option("compression", "gzip").option("maxRecordsPerFile", most).text(path)
    return path


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive file, compressed or not, in members or as a whole."""
    buffer, at = bytearray(), 0

    def pieces() -> Iterator[bytes]:
        if data[:2] != b"\x1f\x8b":
            yield data
            return
        rest = memoryview(data)
        while len(rest):
            inflate = zlib.decompressobj(31)
            for k in range(0, len(rest), 1 << 20):
                yield inflate.decompress(rest[k : k + (1 << 20)])
                if inflate.eof:
                    rest = rest[k + (1 << 20) - len(inflate.unused_data) :] if inflate.unused_data else rest[k + (1 << 20) :]
                    break
            else:
                raise ValueError("an archive file ends within a compressed member")

    source = pieces()

    def fill(until: int) -> bool:
        while len(buffer) < until:
            piece = next(source, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while True:
        while fill(at + 2) and buffer[at : at + 2] == b"\r\n":
            at += 2
        if len(buffer) <= at:
            return
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not fill(len(buffer) + 1):
                raise ValueError("an archive file ends within a record's header")
        lines = buffer[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:60]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at, size = end + 4, int(headers["content-length"])
        if not fill(at + size):
            raise ValueError("an archive file ends within a record's block")
        yield headers, bytes(buffer[at : at + size])
        at += size
        if at > 1 << 22:
            del buffer[:at]
            at = 0


_FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "url": "warc-target-uri", "date": "warc-date", "digest": "warc-payload-digest", "refers_to_record": "warc-refers-to", "page": "x-page-id", "refers_to_page": "x-refers-to-page-id"}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*((name, pa.string()) for name in _FIELDS), ("payload", pa.binary())])
    held: list[dict] = []
    size = 0
    for batch in batches:
        for content in batch.column(0):
            for headers, block in parse_records(content.as_py()):
                _, _, payload = block.partition(b"\r\n\r\n")
                held.append({name: headers.get(key) for name, key in _FIELDS.items()} | {"payload": payload})
                size += len(payload)
                if size > 1 << 22 or len(held) >= 1000:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: headers, ``payload`` as it is stored (empty for revisits), and the stored payload's bytes and digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    schema = ", ".join(f"{name} string" for name in _FIELDS) + ", payload binary"
    out = files.mapInArrow(_parse, schema)
    return out.withColumns(
        {"page_id": F.col("page").cast("long"), "refers_to": F.col("refers_to_page").cast("long"), "stored_bytes": F.octet_length("payload").cast("long"), "stored_digest": F.sha1("payload")}
    ).drop("page", "refers_to_page")


def resolve_revisits(records: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record with ``payload_bytes`` and ``payload_digest`` of the full payload, for revisits their response's; and ``payload`` itself if asked for."""
    names = ["record_id", "record_type", "url", "page_id", "refers_to", "refers_to_record", "stored_bytes", "stored_digest", *(["payload"] if with_payload else [])]
    rows = materialise(records.select(names), "warc-records")
    carried = {"_bytes": F.col("stored_bytes"), "_digest": F.col("stored_digest")} | ({"_payload": F.col("payload")} if with_payload else {})
    responses = rows.filter("record_type = 'response'").dropDuplicates(["record_id"]).select(F.col("record_id").alias("refers_to_record"), *[c.alias(n) for n, c in carried.items()])
    referred = rows.filter("refers_to_record is not null").select("refers_to_record").distinct()
    out = lookup(rows, responses.join(referred, "refers_to_record", "left_semi"), "refers_to_record")
    own = F.col("record_type") == "response"
    out = out.withColumns({"payload_bytes": F.when(own, F.col("stored_bytes")).otherwise(F.col("_bytes")), "payload_digest": F.when(own, F.col("stored_digest")).otherwise(F.col("_digest"))})
    if with_payload:
        out = out.withColumn("payload", F.when(own, F.col("payload")).otherwise(F.col("_payload")))
    return out.drop("_bytes", "_digest", "_payload", "stored_bytes", "stored_digest")
