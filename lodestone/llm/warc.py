"""WARC archives, written and read by an index.

Writing comes with an index: each task appends records to one archive of its own name in the shared
folder and returns file, offset, length, URL, digest and kind of each record; the index is kept as
Parquet. A retried task writes another archive, and only the index rows of the attempt that counts
are kept, so a lost executor leaves at most an unused file. Reading starts from selected index rows:
they are range-partitioned and sorted by file and offset, neighbouring byte ranges are read in one
call of bounded size, and each record is parsed and its payload's digest computed anew.

Of records with equal payloads the one with the largest page_id is the response, the others are
revisits that refer to it and hold only the HTTP header; payloads below ``least_bytes`` are always
responses. Digests are computed and their groups' largest ids found by Spark before any page moves.

Defined cases: null html is an empty payload; a null page_id takes part in no group and is a
response; pages that share id and payload are one response and, for the others, revisits of that
id only if another id is larger, so repeated rows are all responses; null URLs are written as
``urn:page:<id>``, and white space in a URL in percent form (the index keeps the page's own URL); other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, work_path

GAP, MOST_READ = 64 << 10, 8 << 20
INDEX = "page_id long, url string, file string, offset long, length long, digest string, kind string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_DATE = "2000-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of a binary column's SHA-1, by five-byte groups."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_kinds(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, response_id) of the pages that are revisits."""
    digests = pages.filter("page_id is not null").select("page_id", base32_sha1("payload").alias("digest"), F.length("payload").alias("size")).filter(F.col("size") >= least_bytes)
    digests = materialise(digests, "warc-digests")
    largest = digests.groupBy("digest", "size").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return digests.join(largest, ["digest", "size"]).filter("page_id <> response_id").select("page_id", "response_id").distinct()


def _head(kind: str, page_id, url: str, digest: str, refers, block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _clean(url: str | None, page_id) -> str:
    return "".join(quote(c) if c.isspace() else c for c in url) if url and url.strip() else f"urn:page:{page_id}"


def _write(folder: str):
    def run(batches):
        out, path, at = None, None, 0
        try:
            for b in batches:
                rows = {c: [] for c in ("page_id", "url", "file", "offset", "length", "digest", "kind")}
                for page_id, url, payload, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "response_id")), strict=True):
                    if out is None:
                        fs, base = pafs.FileSystem.from_uri(folder)
                        fs.create_dir(base, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc"
                        path, out = f"{folder}/{name}", fs.open_output_stream(f"{base}/{name}", buffer_size=1 << 20)
                    kind = "response" if refers is None else "revisit"
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    target = _clean(url, page_id)
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    block = http + payload if refers is None else http
                    head = _head(kind, page_id, target, digest, refers, block)
                    out.write(head)
                    out.write(block)
                    out.write(b"\r\n\r\n")
                    size = len(head) + len(block) + 4
                    for c, v in zip(rows, (page_id, url, path, at, size, digest, kind), strict=True):
                        rows[c].append(v)
                    at += size
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes a record for each (page_id, url, html) row; returns the index, already stored."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    kinds = record_kinds(pages, least_bytes)
    kinds = materialise(kinds, "warc-kinds").withColumnRenamed("page_id", "_page")
    joined = pages.join(kinds, F.col("page_id") == F.col("_page"), "left").select("page_id", "url", "payload", "response_id")
    index = joined.mapInArrow(_write(folder or work_path(spark, "warc")), INDEX)
    return materialise(index, "warc-index")


def parse(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload of one record."""
    cut = record.index(b"\r\n\r\n")
    lines = record[:cut].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = record[cut + 4 : cut + 4 + int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _ranges(rows: list[tuple[str, int, int]]):
    """Runs of rows, sorted by file and offset, that are read together: (first, last + 1)."""
    lo = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] != rows[lo][0] or rows[i][1] - (rows[i - 1][1] + rows[i - 1][2]) > GAP or rows[i][1] + rows[i][2] - rows[lo][1] > MOST_READ:
            if i > lo:
                yield lo, i
            lo = i


def _read(with_payload: bool):
    def run(batches):
        name, stream = None, None
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            out: list[tuple] = []
            for lo, hi in _ranges(rows):
                if rows[lo][0] != name:
                    if stream is not None:
                        stream.close()
                    name = rows[lo][0]
                    fs, path = pafs.FileSystem.from_uri(name)
                    stream = fs.open_input_file(path)
                begin = rows[lo][1]
                data = stream.read_at(rows[hi - 1][1] + rows[hi - 1][2] - begin, begin)
                for _, offset, length in rows[lo:hi]:
                    fields, http, payload = parse(data[offset - begin : offset - begin + length])
                    number = fields["WARC-Record-ID"][len("<urn:page:") : -1]
                    if fields["WARC-Type"] == "response":
                        size, digest, refers = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), None
                        if fields["WARC-Payload-Digest"] != "sha1:" + digest:
                            raise ValueError(f"record {number}: its payload does not have its digest")
                    else:
                        size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
                        digest, refers = fields["WARC-Payload-Digest"][5:], int(fields["WARC-Refers-To"][len("<urn:page:") : -1])
                    out.append((None if number == "None" else int(number), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], refers, payload if with_payload else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            names = [x.split()[0] for x in RECORD.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names)
        if stream is not None:
            stream.close()

    return run


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the given index rows, read by coalesced byte ranges."""
    laid = index.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return laid.mapInArrow(_read(with_payload), RECORD)
