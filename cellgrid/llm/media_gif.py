"""Media columns for GIF: timed frames with colour histograms, and a GIF writer for 8-bit samples."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellgrid.llm.common import column

# Fixed values of the GIF89a format and of its 8-bit code streams.
CLEAR, END, FIRST_FREE, MAX_CODES = 256, 257, 258, 4096
FULL = MAX_CODES - FIRST_FREE  # codes of an 8-bit stream after which its table is full, of a narrower one a little more
ROWS_PER_FRAME = 4096
BINS = 16
# The largest canvas or frame that is decoded, in pixels; a header that claims more makes its file a broken one.
MOST_PIXELS = 1 << 25
# Frames are handed on once they hold this many bytes.
BATCH_BYTES = 8 << 20
FRAME_FIELDS = "frame int, start_ms long, duration_ms int, left int, top int, width int, height int, disposal int, transparent int, hist_r array<long>, hist_g array<long>, hist_b array<long>, rgba binary"


def _widths(min_bits: int, first: int, n: int) -> np.ndarray:
    """Bits of the codes number first .. first + n - 1 after a clear code."""
    free = np.minimum((1 << min_bits) + 2 + np.maximum(np.arange(first, first + n) - 1, 0), MAX_CODES - 1)
    return np.maximum(np.floor(np.log2(free)).astype(np.int64) + 1, min_bits + 1)


_W8 = _widths(8, 0, FULL + 1)


def lzw_encode(data: bytes) -> bytes:
    """8-bit samples as one LZW code stream: clear, codes, a clear whenever the table is full, end."""
    parts, widths = [np.array([CLEAR])], [np.array([9])]
    table: dict[int, int] = {}
    codes: list[int] = []
    if data:
        at, free, get, put = data[0], FIRST_FREE, table.get, codes.append
        for b in memoryview(data)[1:]:
            key = at << 8 | b
            if (to := get(key)) is None:
                put(at)
                table[key] = free
                free += 1
                at = b
                if free == MAX_CODES:
                    parts.append(np.array([*codes, CLEAR]))
                    widths.append(_W8)
                    codes.clear()
                    table.clear()
                    free = FIRST_FREE
            else:
                at = to
        put(at)
    codes.append(END)
    parts.append(np.array(codes))
    widths.append(_W8[: len(codes)])
    code, width = np.concatenate(parts), np.concatenate(widths)
    at = np.cumsum(width) - width
    value, byte, size = code << (at & 7), at >> 3, int(at[-1] + width[-1] + 7) >> 3
    out = sum(np.bincount(byte + i, weights=(value >> 8 * i) & 255, minlength=size + 3) for i in range(3))
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, min_bits: int, most: int = 1 << 40) -> bytes:
    """The samples of a code stream, at least the first ``most``; it may clear early, late or never, and may lack its end code.

    The widths of codes depend only on how many came since the last clear code, so runs of codes are cut
    out of the bytes at once; only the strings they stand for are built one after another.
    """
    clear, bits = 1 << min_bits, len(stream) * 8
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, prev, at, n, out, size = list(roots), b"", 0, 0, [], 0
    fresh = _W8 if min_bits == 8 else _widths(min_bits, 0, MAX_CODES)
    while True:
        width = fresh if not n else np.full(MAX_CODES, 12)
        pos = at + np.cumsum(width) - width
        pos = pos[pos + width <= bits]
        byte = pos >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (pos & 7) & ((1 << width[: len(pos)]) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        run = codes[: stop[0]] if len(stop) else codes
        strings: list[bytes] = []
        add, put, free = table.append, strings.append, len(table)
        for c in run.tolist():
            if c < free:
                entry = table[c]
            elif c == free and prev:
                entry = prev + prev[:1]
            else:
                raise ValueError("code beyond the table in a GIF image")
            if prev and free < MAX_CODES:
                add(prev + entry[:1])
                free += 1
            put(entry)
            prev = entry
        out.append(b"".join(strings))
        size += len(out[-1])
        if size >= most:
            break
        if len(stop):
            if codes[stop[0]] == clear + 1:
                break
            at = int(pos[stop[0]] + width[stop[0]])
            table, prev, n = list(roots), b"", 0
        elif len(codes) < len(width):
            break
        else:
            at, n = int(pos[-1] + width[len(pos) - 1]), n + len(codes)
    return b"".join(out)


def encode_gif(samples: bytes, width: int = 64, delay_cs: int = 10, rows_per_frame: int = ROWS_PER_FRAME) -> bytes:
    """8-bit samples, a multiple of ``width``, as frames of a grey GIF89a of at most ``rows_per_frame`` rows."""
    if not samples or len(samples) % width:
        raise ValueError("samples must fill rows")
    step = width * rows_per_frame
    tall = min(len(samples), step) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, tall, 0xF7, 0, 0), bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))]
    for lo in range(0, len(samples), step):
        part = samples[lo : lo + step]
        codes = lzw_encode(part)
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0), struct.pack("<BHHHHBB", 0x2C, 0, 0, width, len(part) // width, 0, 8)]
        for i in range(0, len(codes), 255):
            block = codes[i : i + 255]
            out += [bytes([len(block)]), block]
        out.append(b"\0")
    return b"".join([*out, b";"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def decode_gif(data: bytes) -> Iterator[dict]:
    """Timed frames as shown: palette applied, drawn over what disposal left, transparent pixels skipped.

    Yields dicts with the fields of FRAME_FIELDS; ``rgba`` is the whole canvas, the histograms count the
    opaque pixels of the canvas in 16 bins a channel.  ``patch`` is the frame's own rectangle of RGB.  A broken
    file raises ValueError, IndexError or struct.error after the frames before the break; sizes are held
    against MOST_PIXELS before any memory is taken for them.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, tall, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if wide * tall > MOST_PIXELS:
        raise ValueError("too large a GIF")
    shared, at = _palette(data, 13, flags)
    canvas, kept = np.zeros((tall, wide, 4), np.uint8), None
    index = start = delay = disposal = 0
    clear_at: int | None = None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, through = struct.unpack_from("<BHB", body)
                disposal, clear_at = packed >> 2 & 7, through if packed & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown GIF block")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        if w * h > MOST_PIXELS:
            raise ValueError("too large a GIF frame")
        own, at = _palette(data, at + 10, local)
        colours = shared if own is None else own
        if colours is None:
            colours = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
        stream, after = _blocks(data, at + 1)
        drawn = np.frombuffer(lzw_decode(stream, data[at], w * h)[: w * h].ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        at = after
        if local & 0x40:
            order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
            rows = np.empty_like(drawn)
            rows[order] = drawn
            drawn = rows
        if disposal == 3:
            kept = canvas.copy()
        patch = colours[np.minimum(drawn, len(colours) - 1)]
        part = canvas[top : top + h, left : left + w]
        shown = slice(0, part.shape[0]), slice(0, part.shape[1])
        if clear_at is None:
            part[..., :3], part[..., 3] = patch[shown], 255
        else:
            opaque = (drawn != clear_at)[shown]
            part[..., :3][opaque], part[..., 3][opaque] = patch[shown][opaque], 255
        whole = clear_at is None and part.shape == canvas.shape
        seen = canvas[..., :3].reshape(-1, 3) if whole else canvas[canvas[..., 3] == 255][:, :3]
        hist = [np.bincount(seen[:, c] >> 4, minlength=BINS).tolist() for c in range(3)]
        yield {"frame": index, "start_ms": start, "duration_ms": delay * 10, "left": left, "top": top, "width": w, "height": h, "disposal": disposal, "transparent": -1 if clear_at is None else clear_at, "hist_r": hist[0], "hist_g": hist[1], "hist_b": hist[2], "rgba": canvas.tobytes(), "patch": patch}
        if disposal == 2:
            part[...] = 0
        elif disposal == 3 and kept is not None:
            canvas = kept
        index, start, delay, disposal, clear_at = index + 1, start + delay * 10, 0, 0, None


def frames(media: DataFrame, content_col: str = "content", keep_pixels: bool = True) -> DataFrame:
    """One row for each frame of each GIF: the other columns of ``media`` in ``row``, then FRAME_FIELDS.

    Null content gives no frames.  Bytes that are no GIF, or a broken one, give the frames before the break and
    then a row whose frame is -1.  Repeated rows give repeated frames, an empty table none.  Clashing names
    are safe inside ``row``.  Frames are handed on as they are decoded, so a long film needs no more memory
    than a short one.
    """
    names = [c for c in media.columns if c != content_col]
    row = F.struct(*[column(c) for c in names]) if names else F.lit(None).cast("struct<none:int>")
    rows = media.select(row.alias("row"), column(content_col).cast("binary").alias("content"))
    fields = StructType.fromDDL(FRAME_FIELDS)
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "binary": pa.binary()}
    types = [(f.name, kinds[f.dataType.simpleString()]) for f in fields]

    def decoded(data: bytes) -> Iterator[dict]:
        try:
            for f in decode_gif(data):
                yield f if keep_pixels else f | {"rgba": None}
        except (ValueError, IndexError, struct.error):
            yield {"frame": -1}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0

            def out(batch: pa.RecordBatch = batch, found: list = found) -> pa.RecordBatch:
                columns = [pa.array([f.get(n) for _, f in found], t) for n, t in types]
                return pa.RecordBatch.from_arrays([batch.column("row").take(pa.array([i for i, _ in found], pa.int32())), *columns], ["row", *(n for n, _ in types)])

            for i, content in enumerate(batch.column("content")):
                for f in decoded(content.as_py()) if content.is_valid else ():
                    f.pop("patch", None)
                    found.append((i, f))
                    held += len(f.get("rgba") or b"")
                    if held >= BATCH_BYTES:
                        yield out()
                        found.clear()
                        held = 0
            if found:
                yield out()

    return rows.mapInArrow(decode, StructType([rows.schema["row"], *fields]))


def pad(data: bytes, unit: int = 64) -> bytes:
    return data + bytes(-len(data) % unit or (0 if data else unit))


def media_of_text(text: Column, unit: int = 64) -> Column:
    """A GIF whose samples are the UTF-8 bytes of a text (null: empty), zero-padded to whole rows."""

    @F.pandas_udf("binary")
    def stored(texts: pd.Series) -> pd.Series:
        return pd.Series([encode_gif(pad(t or b"", unit), unit) for t in texts])

    return stored(text.cast("binary"))


def media_digest(content: Column) -> Column:
    """Samples read back from a grey GIF: their length, SHA-256 and CRC-32 of the last 64; its own size and
    SHA-256; and a feature text of frame count, canvas, duration and summed histograms.  Null or broken
    content, and a GIF without frames, has its own size and SHA-256 only (null: nothing)."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def digest(content: pd.Series) -> pd.DataFrame:
        out = []
        for data in content:
            if data is None:
                out.append((None,) * 6)
                continue
            sha, n, tail, count, end, hist, size = hashlib.sha256(), 0, b"", 0, 0, np.zeros((3, BINS), np.int64), (0, 0)
            try:
                for f in decode_gif(data):
                    got = f["patch"][..., 0].tobytes()
                    sha.update(got)
                    n, tail, count, end = n + len(got), (tail + got)[-64:], count + 1, f["start_ms"] + f["duration_ms"]
                    hist += np.array([f["hist_r"], f["hist_g"], f["hist_b"]])
                    size = (max(size[0], f["left"] + f["width"]), max(size[1], f["top"] + f["height"]))
            except (ValueError, IndexError, struct.error):
                count = 0
            if not count:
                out.append((None, None, None, len(data), hashlib.sha256(data).hexdigest(), None))
                continue
            feature = f"frames={count};size={size[0]}x{size[1]};ms={end};" + ";".join(f"{c}={','.join(map(str, h))}" for c, h in zip("rgb", hist.tolist(), strict=True))
            out.append((n, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature))
        got = pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        return got.astype({"payload_bytes": "Int64", "tail_crc32": "Int64", "media_bytes": "Int64"})

    return digest(content)
