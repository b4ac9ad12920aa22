"""WARC archives as seekable Zstandard bundles.

A bundle is a file's bytes in a row: independent frames of whole records, and a seek table in a skippable
frame as its footer.  Beside it an index maps each record's identifier to its frame, and its offset and
length within the frame's plain bytes.  Bundles are rows of a table that Spark writes, so a lost executor
or a repeated task leaves no half-written archive; ``export`` writes them as files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.plans.shared import materialize

# Fixed values of the seekable Zstandard format and of WARC 1.1.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20
LEVEL = 3
DATE = "2025-01-01T00:00:00Z"
BUNDLES = "bundle string, content binary, records array<struct<record_id:string,frame:int,offset:long,length:long>>"


def _name(page_id: int | str | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | str | None, url: str | None, payload: bytes, digest: str, refers: int | str | None, revisit: bool, date: str = DATE) -> bytes:
    """One record: a response with its payload, or a revisit that names the response's record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Target-URI: {quote(url or '', safe=PRINTABLE)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers)}", f"WARC-Profile: {IDENTICAL}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer for frames of these (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the footer."""
    count, flags, magic = struct.unpack_from("<IBI", bundle, len(bundle) - 9)
    width = 12 if flags & 0x80 else 8
    start = len(bundle) - 9 - count * width
    if magic != SEEKABLE or struct.unpack_from("<I", bundle, start - 8)[0] != SKIPPABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", bundle, start + i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def bundles_of(records: Iterator[tuple[str, bytes]], frame_bytes: int, bundle_bytes: int) -> Iterator[tuple]:
    """Rows of BUNDLES from (identifier, record) pairs; a record longer than a frame gets a frame of its own."""
    packer = zstandard.ZstdCompressor(level=LEVEL)
    plain, content, sizes, index, held = [], [], [], [], 0

    def close() -> None:
        nonlocal held
        if plain:
            data = b"".join(plain)
            content.append(packer.compress(data))
            sizes.append((len(content[-1]), len(data)))
            plain.clear()
            held = 0

    def bundle() -> tuple:
        data = b"".join(content) + seek_table(sizes)
        row = hashlib.sha256(data).hexdigest()[:32], data, list(index)
        for x in (content, sizes, index):
            x.clear()
        return row

    for name, data in records:
        if held and held + len(data) > frame_bytes:
            close()
            if sum(s[0] for s in sizes) >= bundle_bytes:
                yield bundle()
        index.append((name, len(sizes), held, len(data)))
        plain.append(data)
        held += len(data)
    close()
    if index:
        yield bundle()


def _payload(html: Column) -> Column:
    return F.coalesce(html.cast("binary"), F.lit(b""))


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Rows of BUNDLES that hold a record for every row of ``pages``.

    Of rows with equal payloads (null: empty) of ``min_bytes`` at least, those with the largest id are
    responses and others revisit it; all shorter ones are responses.  A null id is less than any other.
    Rows repeated with one id and payload are of one type.  An empty table gives no bundles; other columns
    are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), _payload(F.col(html_col)).alias("payload")).withColumn("sha", F.sha1("payload"))
    again = rows.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
    again = materialize(again.where("n > 1").select("sha", "newest"), "repeated-payloads")
    # ids travel as text: in pandas a column of longs with a null among them would be rounded to floats
    ids = [F.col(c).cast("string").alias(c) for c in ("page_id", "newest")]
    typed = rows.join(again, "sha", "left").select(*ids, "url", "payload")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records() -> Iterator[tuple[str, bytes]]:
            for b in batches:
                for page, url, payload, newest in zip(b["page_id"], b["url"], b["payload"], b["newest"], strict=True):
                    revisit = newest is not None and page != newest
                    yield _name(page), record(page, url, bytes(payload), base32_sha1(payload), newest, revisit)

        for row in bundles_of(records(), frame_bytes, bundle_bytes):
            yield pd.DataFrame([row], columns=["bundle", "content", "records"])

    return typed.mapInPandas(pack, BUNDLES)


def _parsed(data: bytes) -> tuple:
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError("a record's payload does not have its digest")
    ids = [None if (x := fields.get(k)) is None or x == "<urn:page:null>" else x[10:-1] for k in ("WARC-Record-ID", "WARC-Refers-To")]
    return ids[0], fields["WARC-Target-URI"], size, digest, kind, ids[1], payload if kind == "response" else None


def read_bundles(bundles: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row ``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)`` per record,
    sought by the index: only frames that hold a record asked for are read.  payload is null unless asked for."""
    shown = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener = zstandard.ZstdDecompressor()
        for b in batches:
            for content, records in zip(b["content"], b["records"], strict=True):
                table, now, plain, out = frames_of(content), -1, b"", []
                for r in records:
                    if r["frame"] != now:
                        now = r["frame"]
                        start, packed, size = table[now]
                        plain = opener.decompress(content[start : start + packed], max_output_size=size)
                    row = _parsed(plain[r["offset"] : r["offset"] + r["length"]])
                    out.append(row if with_payload else (*row[:-1], None))
                yield pd.DataFrame(out, columns=[x.split()[0] for x in shown.split(", ")])

    read = bundles.select("content", "records").mapInPandas(unpack, shown)
    return read.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def find_record(bundles: DataFrame, page_id: int) -> DataFrame:
    """The bundles that hold a page's record, with an index of only that record."""
    one = F.filter("records", lambda r: r["record_id"] == F.lit(_name(page_id)))
    return bundles.select("bundle", "content", one.alias("records")).where(F.size("records") > 0)


def export(bundles: DataFrame, folder: str) -> list[str]:
    """Write each bundle as ``<bundle>.warc.zst`` in a folder that all executors mount, from the executors; their names.

    A file gets its name only once it is whole, and a bundle is named by its content, so tasks may be repeated.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = [f"{folder}/{name}.warc.zst" for name in b["bundle"]]
            for name, content in zip(names, b["content"], strict=True):
                part = Path(f"{name}.{uuid.uuid4().hex}")
                part.write_bytes(content)
                part.replace(name)
            yield pd.DataFrame({"path": names})

    return [r["path"] for r in bundles.select("bundle", "content").mapInPandas(write, "path string").toLocalIterator()]
