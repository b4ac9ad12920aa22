"""GIF decoding against a bit-by-bit decoder, hand-made animations, and exact round trips."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellgrid.llm import media_gif
from cellgrid.llm.queries import op2_media_gif


def naive_lzw(stream, min_bits):
    bits = [b >> i & 1 for b in stream for i in range(8)]
    clear, at, size = 1 << min_bits, 0, min_bits + 1
    table, prev, out = {}, None, []
    while at + size <= len(bits):
        code = sum(bits[at + i] << i for i in range(size))
        at += size
        if code == clear:
            table, prev, size = {i: [i] for i in range(clear)}, None, min_bits + 1
            free = clear + 2
            continue
        if code == clear + 1:
            break
        entry = table[code] if code in table else prev + prev[:1]
        if prev is not None and free < 4096:
            table[free] = prev + entry[:1]
            free += 1
            if free == 1 << size and size < 12:
                size += 1
        out += entry
        prev = entry
    return bytes(out)


def plain_codes(samples, min_bits):
    """Codes without any table use: a clear before the width could change."""
    codes, clear = [], 1 << min_bits
    for i, s in enumerate(samples):
        if i % (clear - 2) == 0:
            codes.append(clear)
        codes.append(s)
    codes.append(clear + 1)
    value = sum(c << i * (min_bits + 1) for i, c in enumerate(codes))
    return value.to_bytes(-(-len(codes) * (min_bits + 1) // 8), "little")


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=0, max_size=3000))
def test_lzw_round_trip(data):
    stream = media_gif.lzw_encode(data)
    assert media_gif.lzw_decode(stream, 8) == data == naive_lzw(stream, 8)


def test_lzw_fills_its_table():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 20_000).astype(np.uint8).tobytes() + b"ab" * 9000 + b"\0" * 50_000
    stream = media_gif.lzw_encode(data)
    assert media_gif.lzw_decode(stream, 8) == data == naive_lzw(stream, 8)


def gif(size, frames, palette):
    w, h = size
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0x80 | 1, 0, 0), bytes(palette)]
    for f in frames:
        flags = f.get("disposal", 0) << 2 | ("clear" in f)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, flags, f.get("delay", 0), f.get("clear", 0), 0))
        left, top, fw, fh = f["at"]
        local = f.get("palette")
        out.append(struct.pack("<BHHHHB", 0x2C, left, top, fw, fh, (0x81 if local else 0) | (0x40 if f.get("interlace") else 0)))
        out.append(bytes(local or []))
        codes = plain_codes(f["px"], 2)
        out.append(b"\x02")
        for i in range(0, len(codes), 255):
            out += [bytes([len(codes[i : i + 255])]), codes[i : i + 255]]
        out.append(b"\0")
    return b"".join([*out, b";"])


RED, GREEN, BLUE, WHITE = (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)
PALETTE = [*RED, *GREEN, *BLUE, *WHITE]


def shown(frame, w):
    px = np.frombuffer(frame["rgba"], np.uint8).reshape(-1, 4).tolist()
    return [tuple(p[:3]) if p[3] else None for p in px]


def test_palettes_disposal_transparency_and_time():
    data = gif(
        (2, 2),
        [
            {"at": (0, 0, 2, 2), "px": [0, 1, 2, 3], "delay": 5, "disposal": 1},
            {"at": (0, 0, 2, 1), "px": [3, 0], "delay": 7, "disposal": 3, "clear": 3},
            {"at": (1, 1, 1, 1), "px": [1], "delay": 2, "disposal": 2, "palette": [*WHITE, *BLUE, *WHITE, *WHITE]},
            {"at": (0, 0, 1, 1), "px": [2], "delay": 1},
        ],
        PALETTE,
    )
    got = list(media_gif.decode_gif(data))
    assert shown(got[0], 2) == [RED, GREEN, BLUE, WHITE]
    assert shown(got[1], 2) == [RED, RED, BLUE, WHITE]
    assert shown(got[2], 2) == [RED, GREEN, BLUE, BLUE]
    assert shown(got[3], 2) == [BLUE, GREEN, BLUE, None]
    assert [(f["start_ms"], f["duration_ms"], f["disposal"], f["transparent"]) for f in got] == [(0, 50, 1, -1), (50, 70, 3, 3), (120, 20, 2, -1), (140, 10, 0, -1)]
    assert got[0]["hist_r"][15] == 2 and got[0]["hist_r"][0] == 2 and sum(got[3]["hist_b"]) == 3


def test_interlace():
    rows = [i % 4 for i in range(10)]
    order = [*range(0, 10, 8), *range(4, 10, 8), *range(2, 10, 4), *range(1, 10, 2)]
    data = gif((1, 10), [{"at": (0, 0, 1, 10), "px": [rows[i] for i in order], "interlace": True}], PALETTE)
    (frame,) = media_gif.decode_gif(data)
    assert shown(frame, 1) == [[RED, GREEN, BLUE, WHITE][i] for i in rows]


def test_hostile_headers_take_no_memory(spark):
    """A canvas or a frame of four thousand million pixels, and a code stream far longer than its frame."""
    canvas = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b","
    frame = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0, 0, 0) + struct.pack("<BHHHHBB", 0x2C, 0, 0, 65535, 65535, 0, 8) + b"\0;"
    bomb = media_gif.encode_gif(bytes(1 << 20)).replace(struct.pack("<HHB", 64, 4096, 0), struct.pack("<HHB", 4, 4, 0))
    assert len(media_gif.lzw_decode(media_gif.lzw_encode(bytes(1 << 24)), 8, 16)) < 1 << 23
    good = gif((2, 1), [{"at": (0, 0, 2, 1), "px": [0, 3], "delay": 3}] * 2, PALETTE)
    files = [canvas, frame, bomb, good[:-1] + b"\x99", None, b"", b"no gif"]
    media = spark.createDataFrame([(i, None if f is None else bytearray(f)) for i, f in enumerate(files)], "a long, content binary").withColumnRenamed("a", "a`b")
    got = sorted((r["row"]["a`b"], r["frame"]) for r in media_gif.frames(media).collect())
    assert got == [(0, -1), (1, -1), *((2, i) for i in range(4)), (3, -1), (3, 0), (3, 1), (5, -1), (6, -1)]
    digests = media.select("*", media_gif.media_digest(media["content"]).alias("d")).select("content", "d.*").collect()
    assert [r["payload_bytes"] is not None for r in digests] == [False, False, True, False, False, False, False]
    assert all(r["media_bytes"] == (None if r["content"] is None else len(r["content"])) for r in digests)


def test_frames_table(spark):
    good = gif((2, 1), [{"at": (0, 0, 2, 1), "px": [0, 3], "delay": 3}] * 2, PALETTE)
    rows = [(1, bytearray(good), "a"), (2, None, "b"), (3, bytearray(b"no gif"), "c"), (4, bytearray(good[:40]), "d"), (1, bytearray(good), "a"), (5, bytearray(), "e")]
    got = media_gif.frames(spark.createDataFrame(rows, "page long, content binary, frame string"))
    seen = sorted((r["row"]["page"], r["row"]["frame"], r["frame"]) for r in got.collect())
    assert [s for s in seen if s[0] == 1] == [(1, "a", 0), (1, "a", 0), (1, "a", 1), (1, "a", 1)]
    assert {s for s in seen if s[0] in (3, 5)} == {(3, "c", -1), (5, "e", -1)} and all(s[0] != 2 for s in seen)
    assert media_gif.frames(spark.createDataFrame([], "content binary")).collect() == []


@pytest.mark.parametrize("name", ["odd", "table"])
def test_query_against_brute_force(spark, odd, odd_rows, name, tmp_path):
    if name == "odd":
        odd.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
        rows = [r[:2] for r in odd_rows]
        got = op2_media_gif(spark, str(tmp_path)).collect()
    else:
        rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
        got = op2_media_gif(spark, "/root/testdata/sf0.001").collect()
    want = []
    for i, text in rows:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
        stored = media_gif.encode_gif(payload)
        whole = b"".join(f["patch"][..., 0].tobytes() for f in media_gif.decode_gif(stored))
        assert whole == payload
    key = lambda x: str(x)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    by_payload = {}
    for r in got:
        assert by_payload.setdefault(r["payload_sha256"], tuple(r)[2:]) == tuple(r)[2:]
