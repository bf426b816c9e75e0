"""WARC archives: a writer on Spark's text sink and a Python data source that reads them back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
)

from tabulens.llm.common import ship, written

# Fixed by RFC 4648: the alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
RECORDS_PER_FILE = 20_000
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 16 << 20


def base32_of_hex(digits: Column) -> Column:
    """A 160-bit hex digest in base32, five digits (20 bits) to four letters at a time."""
    value = lambda k: F.conv(F.substr(digits, F.lit(5 * k + 1), F.lit(5)), 16, 10).cast("int")
    letter = lambda k, shift: F.substr(
        F.lit(BASE32), F.shiftright(value(k), shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)
    )
    return F.concat(*[letter(k, shift) for k in range(8) for shift in (15, 10, 5, 0)])


def with_revisits(
    pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0
) -> DataFrame:
    """``id, url, payload`` with ``refers_to``: the smallest id with an equal payload, if it is another's.

    Payloads under ``min_bytes`` bytes refer to none. Only payloads that occur more than once are
    looked up: they are few or many as the data are, so Catalyst chooses the join by their size and
    splits a payload that a large share of the pages has.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = pages.withColumn("payload", payload) if payload_col != "payload" else pages
    keyed = rows.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce("payload", F.lit("")).alias("payload"), F.col("url")
    ).withColumn("same", F.sha2("payload", 256))
    repeated = written(
        keyed.where(F.octet_length("payload") >= min_bytes)
        .groupBy("same")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("same", "first"),
        "repeated",
    )
    return keyed.join(repeated, "same", "left").select(
        "id", "url", "payload", F.when(F.col("id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to")
    )


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    payload_col: str = "html",
    min_bytes: int = 0,
    date: str = "2020-01-01T00:00:00Z",
) -> None:
    """One record per row of ``pages(id, url, payload)`` into gzip archives under ``path``.

    Of records with equal payloads of at least ``min_bytes`` UTF-8 bytes, the one with the smallest
    id is a response and the others revisit it; repeated rows of that id are responses too. A null
    payload is empty, a null address is written as ``urn:page:`` and the id; rows with a null id have
    no page id and are never referred to. Spark's text sink writes and commits the files, so they may
    lie in any store, and a lost task leaves none; its line separator is the one that ends a record.
    """
    rows = with_revisits(pages, id_col, payload_col, min_bytes)
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    target = F.regexp_replace(F.coalesce("url", name(F.col("id"))), r"[\x00-\x20\x7f]", "%20")
    revisit = F.col("refers_to").isNotNull()
    # Ids are decimal digits; texts are UTF-8, so lengths in bytes are octet lengths.
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(END + END),
    )
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(END))
    none = F.lit("")
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), name(F.col("id")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.sha1("payload")))),
        F.coalesce(line("WARC-Page-ID", F.col("id").cast("string")), none),
        F.when(
            revisit,
            F.concat(
                line("WARC-Refers-To", F.concat(F.lit("<"), name(F.col("refers_to")), F.lit(">"))),
                line("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string")),
                line("WARC-Profile", F.lit(REVISIT_PROFILE)),
            ),
        ).otherwise(none),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    record = F.concat(head, F.lit(END), block)
    rows.select(record.alias("value")).write.option("lineSep", END + END).option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


SCHEMA = (
    "record_type string, record_id string, target_uri string, page_id string, refers_to string,"
    " headers map<string,string>, block_bytes long, payload_bytes long, payload_sha1 string, payload string"
)
# Columns that come from a header of the record, and so can be tested before its block is read.
HEADER_OF = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "page_id": "WARC-Page-ID",
    "refers_to": "WARC-Refers-To-Page-ID",
}
# Names are the same in any case; these are looked up.
KNOWN = {n.lower(): n for n in (*HEADER_OF.values(), "Content-Length", "Content-Type", "WARC-Payload-Digest")}


def read_archives(
    spark: SparkSession, path: str, payload: bool = True, verify: bool = False, unchunk: bool = False
) -> DataFrame:
    """The records of the archives under ``path``, filtered before their payloads are decoded.

    Equality and membership tests on the columns of ``HEADER_OF`` reach the reader. With ``payload``
    false payloads stay null and unread; with ``verify`` their SHA-1 is taken from the bytes read. With
    ``unchunk`` chunked transfer coding is undone before either. Header names are read in any case.
    """
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    options = {"payload": str(payload).lower(), "verify": str(verify).lower(), "unchunk": str(unchunk).lower()}
    records = spark.read.format("warc").options(**options).load(path)
    # Spark keeps the predicates last pushed to a Python source for a later query that pushes none, so
    # every query pushes one. The type is a header that each record must have.
    return records.where("record_type IS NOT NULL")


class WarcDataSource(DataSource):
    """``spark.read.format("warc")``: one row per record of all files, plain or gzip, under a path.

    ``read_archives`` is the way to it: a frame read by the format's name alone, filtered once and then
    used without a filter, would see the first filter's records only.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> WarcReader:
        return WarcReader(dict(self.options))


@dataclass
class Files(InputPartition):
    """Whole files for one task; a file is not cut, as nothing marks a record's start for certain."""

    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true") == "true"
        self.verify = options.get("verify", "false") == "true"
        self.unchunk = options.get("unchunk", "false") == "true"
        self.allowed: dict[str, set[str]] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for test in filters:
            header = HEADER_OF.get(test.attribute[0]) if len(getattr(test, "attribute", ())) == 1 else None
            if header and isinstance(test, IsNotNull):
                self.present.add(header)
            elif header and isinstance(test, EqualTo | EqualNullSafe) and test.value is not None:
                self._allow(header, {test.value})
            elif header and isinstance(test, In):
                self._allow(header, {v for v in test.value if v is not None})
            else:
                yield test

    def _allow(self, header: str, values: set[str]) -> None:
        self.allowed[header] = self.allowed.get(header, values) & values

    def partitions(self) -> list[Files]:
        store, root = fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted(
            (f.path, f.size)
            for f in found
            if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", "."))
        )
        out, size = [Files([])], 0
        for path, n in files:
            if out[-1].paths and size + n > PARTITION_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        # Small archives are dealt over more tasks.
        if len(out) == 1 and len(files) > 1:
            return [Files([path]) for path, _ in files]
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if ":/" in self.path else fs.LocalFileSystem()
        kind = pa.schema(
            [
                *[pa.field(n, pa.string()) for n in HEADER_OF],
                pa.field("headers", pa.map_(pa.string(), pa.string())),
                pa.field("block_bytes", pa.int64()),
                pa.field("payload_bytes", pa.int64()),
                pa.field("payload_sha1", pa.string()),
                pa.field("payload", pa.string()),
            ]
        )
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as raw:
                stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
                for row in records(stream, self):
                    rows.append(row)
                    held += row[6]
                    if held > BATCH_BYTES or len(rows) == 4096:
                        yield _batch(rows, kind)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, kind)


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind
    )


class Buffered:
    """Lines, exact reads and skips over a stream that only reads."""

    def __init__(self, stream: Any) -> None:
        self.stream, self.data, self.at = stream, b"", 0
        # Bytes of the line read last, its end included.
        self.took = 0

    def _more(self, least: int) -> bool:
        part = self.stream.read(max(least, 1 << 18))
        self.data, self.at = self.data[self.at :] + part, 0
        return bool(part)

    def line(self) -> bytes:
        """The next line without its end; empty at the end of the stream."""
        begin = 0
        while (end := self.data.find(b"\n", self.at + begin)) < 0:
            begin = len(self.data) - self.at
            if not self._more(1):
                end = len(self.data)
                break
        after = min(end + 1, len(self.data))
        self.took = after - self.at
        found, self.at = self.data[self.at : end], after
        return found.rstrip(b"\r")

    def ended(self) -> bool:
        return self.at >= len(self.data) and not self._more(1)

    def read(self, n: int) -> bytes:
        while len(self.data) - self.at < n:
            if not self._more(n - len(self.data) + self.at):
                raise EOFError("an archive ends inside a record")
        found, self.at = self.data[self.at : self.at + n], self.at + n
        return found

    def skip(self, n: int) -> None:
        while n:
            step = min(n, 1 << 20)
            self.read(step)
            n -= step


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked message; bytes that are not chunked as they should be stay as they are."""
    source, parts = Buffered(io.BytesIO(body)), []
    try:
        while n := int(source.line().partition(b";")[0].strip(), 16):
            parts.append(source.read(n))
            source.line()
    except (ValueError, EOFError):
        return body
    return b"".join(parts)


def records(stream: Any, wanted: WarcReader) -> Iterator[tuple]:
    """Rows of one archive; blocks that no filter lets through are passed over undecoded."""
    source = Buffered(stream)
    while not source.ended():
        version = source.line()
        if not version:
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a record: {version[:40]!r}")
        headers = {}
        while text := source.line():
            key, _, value = text.decode("utf-8", "replace").partition(":")
            headers[KNOWN.get(key.strip().lower(), key.strip())] = value.strip()
        size = int(headers["Content-Length"])
        if any(h not in headers for h in wanted.present) or any(
            headers.get(h) not in values for h, values in wanted.allowed.items()
        ):
            source.skip(size)
            continue
        n_bytes, digest, payload, chunked = None, None, None, False
        left = size
        if headers.get("Content-Type", "").lower().startswith("application/http"):
            while left > 0:
                text = source.line()
                left -= source.took
                if not text:
                    break
                name, _, value = text.lower().partition(b":")
                if name.strip() == b"content-length":
                    n_bytes = int(value)
                elif name.strip() == b"transfer-encoding":
                    chunked = value.split(b",")[-1].strip() == b"chunked"
        if headers.get("WARC-Type") == "revisit" or not (wanted.payload or wanted.verify):
            source.skip(left)
            n_bytes = left if n_bytes is None else n_bytes
        else:
            body = source.read(left)
            if chunked and wanted.unchunk:
                body = unchunked(body)
            n_bytes = len(body)
            if wanted.verify:
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            if wanted.payload:
                payload = body.decode("utf-8", "replace")
        yield (
            *[headers.get(h) for h in HEADER_OF.values()],
            list(headers.items()),
            size,
            n_bytes,
            digest,
            payload,
        )


def archived_pages(spark: SparkSession, pages: DataFrame, path: str, **options: Any) -> DataFrame:
    """Write ``pages`` to archives under ``path`` and read each record back, digests checked.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``; a response whose bytes no
    longer have the digest in its header is an error.
    """
    write_archives(pages, path, **options)
    found = read_archives(spark, path, payload=False, verify=True)
    told = F.regexp_replace(F.col("headers")["WARC-Payload-Digest"], "^sha1:", "")
    checked = F.when(
        F.col("payload_sha1").isNotNull() & (F.col("payload_sha1") != told),
        F.raise_error(F.concat(F.lit("changed payload in "), "record_id")).cast("string"),
    ).otherwise(F.coalesce("payload_sha1", told))
    return found.select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        checked.alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )
