"""WARC archives, Zstandard-compressed: writer and reader.

An archive begins with a skippable frame that holds the dictionary; every
record is one frame of its own. The writer makes one record per page: the
first record of a payload is a `response`, later ones (by page_id) a `revisit`
that names it and carries no payload. Which is which is decided on narrow
rows: the SHA-1 of the payload is pre-aggregated per (digest, salt), so a
payload that a third of the pages share is never gathered; then the decision
is joined to the page by its identifier, the only shuffle of HTML.

The reader loads the dictionary from the leading frame, decodes frame by frame
with memory for one record, and checks version line, mandatory headers, block
length, payload length and payload digest; anything wrong raises.

Edge cases: null html is an empty payload; a null url has no target header; a
null page_id is the last choice for a response and gives the identifier null;
rows repeated with the same page_id and html are numbered, the first one counts
as the original; an empty table writes no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, scratch_path
from .common import whole_text, with_group_totals
from .files import fresh_file, open_input, open_output

# Fixed values of the formats.
VERSION = "WARC/1.1"
DICT_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:page:"

ARCHIVE_BYTES = 64 << 20    # an archive is closed when it has this size
TASK_BYTES = 64 << 20       # bytes of archives that a reading task takes on average
SAMPLE_PAGES, SAMPLE_CHARS, DICT_BYTES = 512, 8192, 32 << 10
SALTS = 256
READ_BYTES = 128 << 10


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(pages: DataFrame, html_col: str = "html") -> bytes | None:
    """A dictionary from a bounded sample: SAMPLE_PAGES beginnings of pages.
    None if the sample is too small to train on."""
    import zstandard
    rows = (pages.select(F.substring(whole_text(F.col(html_col)), 1, SAMPLE_CHARS).alias("h"))
            .limit(SAMPLE_PAGES).collect())
    samples = [r["h"].encode() for r in rows if r["h"]]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) >= 16 else None
    except zstandard.ZstdError:
        return None


def _head(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _uri(url: str) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")


def _urn(page_id, nth: int = 1) -> str:
    return f"<{PAGE_URN}{'null' if page_id is None else page_id}{'' if nth == 1 else f':{nth}'}>"


def record(page_id, nth: int, url: str | None, payload: bytes, kind: str, refers_to, date: str) -> bytes:
    digest = payload_digest(payload)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id, nth)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _uri(url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to)), ("WARC-Truncated", "length")]
        return _head(fields, http)
    return _head(fields, http + payload)


class ArchiveWriter:
    def __init__(self, folder: str, dictionary: bytes | None, level: int = 3):
        import zstandard
        self.path = fresh_file(folder, ".warc.zst")
        self.out = open_output(self.path)
        self.records = self.size = 0
        plain = zstandard.ZstdCompressor(level=level)
        if dictionary:
            packed = plain.compress(dictionary)
            self._put(struct.pack("<II", DICT_FRAME, len(packed)) + packed)
            self.z = zstandard.ZstdCompressor(level=level, write_checksum=True,
                                              dict_data=zstandard.ZstdCompressionDict(dictionary))
        else:
            self.z = zstandard.ZstdCompressor(level=level, write_checksum=True)

    def _put(self, b: bytes) -> None:
        self.out.write(b)
        self.size += len(b)

    def add(self, rec: bytes) -> None:
        self._put(self.z.compress(rec))
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        return {"path": self.path, "n_records": self.records, "n_bytes": self.size}


def frames(stream):
    """The decoded records of an archive, one frame at a time."""
    import zstandard
    buf, z, first = b"", zstandard.ZstdDecompressor(), True
    while True:
        while len(buf) < 8 and (more := stream.read(READ_BYTES)):
            buf += more
        if not buf:
            return
        if len(buf) >= 8 and (magic := struct.unpack_from("<I", buf)[0]) in SKIPPABLE:
            size = 8 + struct.unpack_from("<I", buf, 4)[0]
            while len(buf) < size:
                if not (more := stream.read(max(READ_BYTES, size - len(buf)))):
                    raise ValueError("archive ends inside a skippable frame")
                buf += more
            if first and magic == DICT_FRAME:
                data = buf[8:size]
                if data[:4] == FRAME_MAGIC:
                    data = zstandard.ZstdDecompressor().decompress(data)
                z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
            buf, first = buf[size:], False
            continue
        first, d, parts = False, z.decompressobj(), []
        while not d.eof:
            if not buf and not (buf := stream.read(READ_BYTES)):
                raise ValueError("archive ends inside a record")
            parts.append(d.decompress(buf))
            buf = d.unused_data if d.eof else b""
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record, validated."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not sep or not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in headers:
            raise ValueError(f"bad header line {line!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name} header")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("block length differs from Content-Length")
    return headers, rest[:n]


def _page_of(urn: str) -> int | None:
    name = urn.strip("<>").removeprefix(PAGE_URN).split(":")[0]
    return None if name == "null" else int(name)


def record_row(data: bytes) -> dict:
    """What the archive says of a page; lengths and digest are checked."""
    headers, block = parse_record(data)
    http, sep, payload = block.partition(b"\r\n\r\n")
    status, *lines = http.decode("latin-1").split("\r\n")
    if not sep or not status.startswith("HTTP/1."):
        raise ValueError("block is not an HTTP response")
    size = int(dict(x.split(": ", 1) for x in lines)["Content-Length"])
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != size or payload_digest(payload) != digest:
            raise ValueError("payload differs from its length or digest")
    elif kind != "revisit" or payload:
        raise ValueError(f"unexpected {kind} record")
    return {"page_id": _page_of(headers["warc-record-id"]), "url": headers.get("warc-target-uri"),
            "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": _page_of(headers["warc-refers-to"]) if kind == "revisit" else None,
            "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id",
                   url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z",
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """One record per page; the manifest has path, n_records, n_bytes.
    Payloads below `min_bytes` are all written as responses."""
    dictionary = train_dictionary(pages, html_col)
    src = (pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"),
                        whole_text(F.col(html_col)).alias("_html"))
           .withColumn("_sha", F.sha1(F.encode("_html", "UTF-8")))
           .withColumn("_key", F.coalesce(F.col("_id").cast("string"), F.lit("null"))))
    narrow = checkpointed(
        src.select("_id", "_key", "_sha").distinct()
        .withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")), "warc-digests")
    parts = narrow.groupBy("_sha", "_salt").agg(F.min("_id").alias("_part_first"))
    firsts = (with_group_totals(narrow, "_sha", "_salt", parts, {"_first": F.min("_part_first")})
              .select("_key", "_sha", "_first"))
    # join and numbering need the same partitioning: HTML is shuffled once
    joined = src.join(firsts, ["_key", "_sha"])
    nth = Window.partitionBy("_key", "_sha").orderBy("_url")
    records = (
        joined.withColumn("_nth", F.row_number().over(nth))
        .withColumn("_kind", F.when(
            (F.octet_length("_html") < min_bytes)
            | (F.col("_id").eqNullSafe(F.col("_first")) & (F.col("_nth") == 1)), "response").otherwise("revisit"))
        .select("_id", "_nth", "_url", "_html", "_kind", "_first"))

    def run(batches):
        writer = None
        for b in batches:
            for row in range(b.num_rows):
                page_id, n, url, html, kind, first = (b.column(k)[row].as_py() for k in range(6))
                writer = writer or ArchiveWriter(folder, dictionary)
                writer.add(record(page_id, n, url, html.encode(), kind, first, date))
                if writer.size >= archive_bytes:
                    yield pa.RecordBatch.from_pylist([writer.close()])
                    writer = None
        if writer:
            yield pa.RecordBatch.from_pylist([writer.close()])

    return checkpointed(records.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False, batch_bytes: int = 16 << 20,
                  read_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per record of the archives that a manifest names. One task reads
    about `read_bytes` of archives, at least one of them."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.int64()}
    if with_payload:
        kinds["payload"] = pa.binary()
    schema = pa.schema(list(kinds.items()))

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with open_input(path) as f:
                    for data in frames(f):
                        row = record_row(data)
                        rows.append({k: row[k] for k in kinds})
                        size += 200 + (len(row["payload"] or b"") if with_payload else 0)
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    spark_type = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    # a stated number of partitions, which adaptive execution does not merge by
    # the few bytes of the manifest
    total = manifest.agg(F.sum("n_bytes")).first()[0] or 0
    return (manifest.select("path").repartition(-(-total // read_bytes) or 1)
            .mapInArrow(run, ", ".join(f"{k} {spark_type[t]}" for k, t in kinds.items())))


def archive_round_trip(pages: DataFrame, folder: str | None = None, **kw) -> DataFrame:
    """Write the archives and return what reading them back says of each page."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, **kw))
