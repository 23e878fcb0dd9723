"""WARC archives of pages, compressed with a Zstandard dictionary.

A dictionary is built from a bounded sample of the records. Every archive begins with a skippable frame that holds it (magic number
0x184D2A5D), then a `warcinfo` record and one frame for each record. Of equal payloads one is a `response`, the others are `revisit`
records that refer to it. Payloads are found equal by their SHA-256, grouped before any page is moved.

Archives are written by Spark's text writer, so that they are committed whole, survive lost executors and may lie in any store
that Spark writes to: a row is a frame as it is, and the line separator is an empty skippable frame, which readers of Zstandard pass over.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize, shared_dir, table

#: An empty skippable frame (magic number 0x184D2A50, length 0): the line separator.
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
DICTIONARY_FRAME = 0x184D2A5D
#: The sample for the dictionary: records, and the bytes of the longest payload in it; the dictionary's size.
SAMPLE, LONGEST, DICTIONARY = 250, 32 << 10, 64 << 10
#: Bytes of payload of an archive, about, and records of an archive of revisits.
ARCHIVE, REVISITS = 64 << 20, 100_000
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def _urn(page: str | None, row: int) -> str:
    return f"<urn:page:{'' if page is None else 'p' + quote(page, safe='')}:{row}>"


def _page(urn: str) -> str | None:
    name = urn.removeprefix("<urn:page:").rsplit(":", 1)[0]
    return unquote(name[1:]) if name else None


def _uri(url: str | None) -> str:
    """The target, with anything that may not stand in a header line percent-encoded."""
    return quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~")


def record(row: dict) -> bytes:
    """The WARC record of a row: page, row, url, sha1 (hex), size; html of a response, or keep_page and keep_row of a revisit."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    http = _HTTP.format(row["size"]).encode()
    revisit = row["keep_row"] is not None
    block = http if revisit else http + row["html"]
    fields = [("WARC-Record-ID", _urn(row["page"], row["row"])), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(row["url"])), ("WARC-Payload-Digest", digest)]
    fields += [("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(row["keep_page"], row["keep_row"])), ("WARC-Refers-To-Date", DATE)]
    return _record("revisit" if revisit else "response", [*fields, ("Content-Type", "application/http; msgtype=response")], block)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time, so that only one page is a Python object."""
    names = batch.schema.names
    for i in range(batch.num_rows):
        yield {n: batch.column(j)[i].as_py() for j, n in enumerate(names)}


def staged(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """page, row (a number for every row), url, html, size, sha1, sha256; written once, so that row numbers hold."""
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), body.alias("html")).withColumn("row", F.monotonically_increasing_id())
    return materialize(rows.withColumns({"size": F.octet_length("html").cast("long"), "sha1": F.sha1("html"), "sha256": F.sha2("html", 256)}), "warc-pages")


def revisits(rows: DataFrame, least: int) -> DataFrame:
    """Rows that repeat the payload of another: page, row, url, size, sha1, keep_page, keep_row (largest page id, then row)."""
    large = rows.filter(F.col("size") >= least).select("page", "row", "url", "size", "sha1", "sha256")
    keep = F.max(F.struct(F.col("page").isNotNull().alias("has"), F.col("page").alias("page"), F.col("row").alias("row")))
    groups = large.groupBy("sha256").agg(keep.alias("keep"), F.count("*").alias("n")).filter("n > 1").select("sha256", F.col("keep.page").alias("keep_page"), F.col("keep.row").alias("keep_row"))
    # Rows without their pages; a hot payload is split by adaptive execution.
    found = large.join(groups, "sha256").filter("row <> keep_row")
    return materialize(found.select("page", "row", "url", "size", "sha1", "keep_page", "keep_row"), "warc-revisits")


def dictionary(rows: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, size: int = DICTIONARY) -> bytes:
    """A Zstandard dictionary from at most `sample` whole records (by a hash of their row number) with payloads up to `longest` bytes. Empty if they are too few."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = [record(r) for b in batches for r in _rows(b)]
        try:
            made = zstandard.train_dictionary(size, records).as_bytes()
        except zstandard.ZstdError:
            made = b""
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([made], pa.binary())})

    slim = rows.filter(F.col("size") <= longest).select("row").orderBy(F.xxhash64("row"), "row").limit(sample)
    chosen = rows.join(F.broadcast(slim), "row").select(*_fields(rows))
    made = chosen.coalesce(1).mapInArrow(train, "dictionary binary").first()
    return bytes(made[0]) if made else b""


def _fields(rows: DataFrame) -> list:
    none = F.lit(None)
    has = set(rows.columns)
    return [F.col("page").cast("string").alias("page"), "row", "url", "size", "sha1", F.col("html") if "html" in has else none.cast("binary").alias("html"),
            F.col("keep_page").cast("string").alias("keep_page") if "keep_page" in has else none.cast("string").alias("keep_page"), F.col("keep_row") if "keep_row" in has else none.cast("long").alias("keep_row")]


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Write the rows of `pages` as WARC archives into the folder `path`, each dealt about 64 MB of payload.

    Of rows with equal payloads of at least `least` bytes the one with the largest page id (nulls are smallest, then the last row) is a
    response and the others revisit it; smaller payloads are all responses. Null pages are empty, null ids and urls are kept as such;
    repeated rows are records of their own. Long pages are written whole; other columns are left out. An empty table gives no archive.
    """
    rows = staged(pages, page_id, url, html)
    again = revisits(rows, least)
    learned = dictionary(rows)
    total = rows.agg(F.count("*"), F.sum("size")).first()

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = zstandard.ZstdCompressionDict(learned) if learned else None
        if kept:
            kept.precompute_compress(level=LEVEL)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=kept)
        begun = False
        for b in batches:
            made, held = [], 0
            for r in _rows(b):
                if not begun:
                    if learned:
                        made.append(struct.pack("<II", DICTIONARY_FRAME, len(learned)) + learned)
                    info = [("WARC-Record-ID", f"<urn:info:{r['row']}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
                    made.append(pack.compress(_record("warcinfo", info, b"format: WARC File Format 1.1\r\n")))
                    begun = True
                made.append(pack.compress(record(r)))
                held += len(made[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pydict({"frame": pa.array(made, pa.binary())})
                    made, held = [], 0
            if made:
                yield pa.RecordBatch.from_pydict({"frame": pa.array(made, pa.binary())})

    n = max(1, -(-(total[1] or 0) // ARCHIVE), -(-total[0] // REVISITS))
    # Pages are dealt to archives once, by their row number: equal pages fall apart, so no archive is larger than others.
    new = rows.repartition(n, "row").join(again.select("row").repartition(n, "row"), "row", "left_anti").select(*_fields(rows))
    old = again.select(*_fields(again)).repartition(max(1, -(-again.count() // REVISITS)))
    # Frames are bytes; the cast to string only passes them on.
    out = new.unionAll(old).mapInArrow(frames, "frame binary")
    out.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)
    for t in (rows, again):
        discard(t)


def dictionary_of(data: memoryview) -> tuple[bytes, int]:
    """The dictionary of an archive and where its records begin."""
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        end = 8 + struct.unpack_from("<I", data, 4)[0]
        return bytes(data[8:end]), end
    return b"", 0


def records(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of an archive."""
    learned, at = dictionary_of(memoryview(data))
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(learned) if learned else None)
    reader = io.BufferedReader(unpack.stream_reader(memoryview(data)[at:], read_across_frames=True), 1 << 16)
    while version := reader.readline():
        if not version.startswith(b"WARC/1."):
            raise ValueError(f"no record begins with {version[:20]!r}")
        fields = {}
        while (line := reader.readline()) not in (b"\r\n", b""):
            k, v = line.decode().rstrip("\r\n").split(": ", 1)
            fields[k] = v
        block = reader.read(int(fields["Content-Length"]))
        if reader.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield fields, block


def read(spark: SparkSession, path: str, page_type: str = "long") -> DataFrame:
    """The records of archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest, html (null in revisits).

    Digests of blocks and payloads are checked while reading; a wrong one raises an error. `warcinfo` records are passed over.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                done, held = [], 0
                for fields, block in records(memoryview(b.column(0)[i].as_buffer())):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    if fields["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
                        raise ValueError(f"block of {fields['WARC-Record-ID']} was changed")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(h for h in http.decode().split("\r\n") if h.lower().startswith("content-length:")).split(":")[1])
                    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
                    if not revisit:
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if digest != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} was changed")
                    done.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], _page(fields["WARC-Refers-To"]) if revisit else None, size, digest, None if revisit else payload.decode()))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), out.types, strict=True)], schema=out)
                        done, held = [], 0
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), out.types, strict=True)], schema=out)

    text = pa.string()
    out = pa.schema([("page_id", text), ("url", text), ("record_type", text), ("refers_to", text), ("payload_bytes", pa.int64()), ("payload_digest", text), ("html", text)])
    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInArrow(parse, "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, html string")
    return found.withColumns({c: F.col(c).cast(page_type) for c in ("page_id", "refers_to")})


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page of `pages`, read back from the archives that hold it."""
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return read(spark, path, pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex, coalesce(html, '') AS payload FROM pages
), k AS (
  SELECT payload, max(page_id) AS keep FROM p GROUP BY payload
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s: '{_BASE32}'[((CAST('0x' || hex[5 * g + 1 : 5 * g + 5] AS BIGINT) >> s) & 31) + 1]), '')), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM p JOIN k USING (payload)
"""
