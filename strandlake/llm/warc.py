"""Operator 6, WARC: writing gzip members, and a splittable reader.

The writer makes one gzip member a record. Of records with equal payloads that with the largest page_id is the response;
the others are revisits without payload. A task writes files of its own name and reports them in a manifest, which is
stored: what a lost task left is in no manifest and never read.

The reader deals out byte ranges. A task looks for gzip's magic from its range's start, takes a candidate for a member
only if its start decodes to a WARC header, and then walks from member to member; records that start inside the range
are its own, and it reads past the end to finish the last. After a damaged member it looks for the next magic.

Defined cases: a null page is an empty payload; equal page_ids with equal payloads: all rows of the largest are
responses; a null page_id is smaller than any other, and rows of null ids alone are responses; payloads of any length
are streamed member by member; an empty table makes no archive and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, scratch_path, table

MAGIC = b"\x1f\x8b\x08"
ARCHIVE_BYTES, SPLIT_BYTES, CHUNK = 1 << 30, 32 << 20, 1 << 20
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def open_path(path: str):
    return fs.FileSystem.from_uri(path)


def record(page_id, url, payload: bytes, first_id, is_revisit: bool) -> bytes:
    """One record; a revisit holds the HTTP header alone, whose Content-Length still tells the payload's length."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first_id}>"]
    head += ["WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, wbits=31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes (page_id, url, html) below folder; gives the manifest (path, bytes, records)."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    repeated = materialize(pages.groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("first_id")).filter("n > 1").select("sha", "first_id"), "warc-repeats")
    pages = pages.join(broadcast_if_small(repeated), "sha", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    pages = pages.select("page_id", "url", "html", "first_id", revisit.alias("is_revisit"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, path, size, n = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, first_id, is_revisit in zip(*(batch[c].array for c in batch.columns), strict=True):
                if out is None:
                    store, place = open_path(folder)
                    store.create_dir(place, recursive=True)
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    path, out, size, n = f"{folder}/{name}", store.open_output_stream(f"{place}/{name}", compression=None), 0, 0
                raw = html.encode("utf-8", "replace")
                data = member(record(None if pd.isna(page_id) else int(page_id), url, raw, None if pd.isna(first_id) else int(first_id), bool(is_revisit)))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [path], "bytes": [size], "records": [n]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [size], "records": [n]})

    return materialize(pages.mapInPandas(write, "path string, bytes long, records long"), "warc-manifest")


class Window:
    """Forward reads of a file; it holds little more than a chunk."""

    def __init__(self, file, start: int):
        self.file, self.base, self.data, self.ended = file, start, b"", False
        file.seek(start)

    def at(self, place: int, most: int) -> bytes:
        """The bytes from place on: so many, or up to the file's end."""
        while place + most > self.base + len(self.data) and not self.ended:
            more = self.file.read(CHUNK)
            self.ended = not more
            self.data, self.base = self.data[place - self.base :] + more, place
        return self.data[place - self.base : place - self.base + most]


def decode(window: Window, start: int) -> tuple[bytes, int] | None:
    """The member at start and where it ends; None if it is none, or none of WARC."""
    d, out, place, step = zlib.decompressobj(wbits=31), [], start, 1 << 12
    try:
        while not d.eof:
            data = window.at(place, step)
            if not data:
                return None
            out.append(d.decompress(data))
            place += len(data)
            if step == 1 << 12 and (head := b"".join(out)):  # a few bytes tell a WARC header
                if len(head) >= 7 and not head.startswith(b"WARC/1."):
                    return None
                step = 1 << 16
    except zlib.error:
        return None
    data = b"".join(out)
    return (data, place - len(d.unused_data)) if data.startswith(b"WARC/1.") else None


def records_in(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records of the members that start in [start, end)."""
    window, place, synced = Window(file, start), start, False
    while place < min(end, size):
        if not synced:
            data = window.at(place, CHUNK)
            if (k := data.find(MAGIC)) < 0:
                place += max(1, len(data) - 2)
                continue
            place += k
            if place >= end:
                return
        found = decode(window, place)
        synced = found is not None
        if found is None:  # the bytes after the candidate's first are looked at again
            place += 1
            window = Window(file, place)
            continue
        yield found[0]
        place = found[1]


def parse(data: bytes) -> tuple:
    """RECORDS' values of one record, its digest checked against the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, number(fields.get("WARC-Refers-To", "")), length, digest, payload if kind == "response" else None


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """RECORDS of the archives in (path, bytes), read by ranges of split_bytes."""
    ranges = archives.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    dealt = ranges.repartition(max(1, min(10_000, ranges.count())))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = dict.fromkeys(("page_id", "refers_to", "payload_bytes"), "Int64")
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["bytes"], batch["start"], strict=True):
                store, place = open_path(path)
                with store.open_input_file(place) as file:
                    rows, held = [], 0
                    for data in records_in(file, size, start, start + split_bytes):
                        row = parse(data)
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(data) if payloads else 200
                        if held > 16 << 20:
                            yield pd.DataFrame(rows, columns=names).astype(types)
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names).astype(types)

    return dealt.mapInPandas(read, RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), scratch_path(spark, "warc"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, {5 * i + 1}, 5))::BIGINT >> {shift}) & 31)::INT, 1)" for i in range(8) for shift in (15, 10, 5, 0)
)
ORACLE_SQL = f"""
WITH digests AS (SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
firsts AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS first_id FROM digests)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to, url
FROM firsts
"""
