"""Rice coding of packed integer arrays, as FITS defines it for compressed tiles (RICE_1).

The first sample is stored in full.  Each block of samples then has a code of its own: differences, folded to be
positive, keep their low bits and have the rest in unary; a block of zeros is its code alone, and one of large
differences is stored in full.  numpy works on many arrays at a time, in step, so nothing runs per sample in Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format, by bytes of a sample: bits of a block's code, and low bits from which a block is stored in full.
CODE_BITS = {1: 3, 2: 4, 4: 5}
FULL_FROM = {1: 6, 2: 14, 4: 25}
TYPES = {"byte": "u1", "short": "i2", "ushort": "u2", "long": "i4"}
# Arrays that are decoded in step.
TOGETHER = 1024


def _low_bits(total: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Low bits kept in blocks of ``counts`` folded differences with these sums: the bits of half their mean."""
    half = np.maximum((total - counts // 2 - 1) / counts, 0).astype(np.int64) >> 1
    return np.where(half > 0, np.frexp(half.astype(float))[1], 0).astype(np.int64)


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
    """Set ``width`` bits, highest first, from each place on."""
    for j in range(int(width.max(initial=0))):
        on = width > j
        bits[at[on] + width[on] - 1 - j] = (value[on] >> j) & 1


def encode(x: np.ndarray, block: int = 32) -> list[bytes]:
    """Each row of an integer array (u1, i2, u2 or i4) as a stream of bits."""
    rows, n = x.shape
    size = x.dtype.itemsize
    if n == 0:
        return [b""] * rows
    w, code = 8 * size, CODE_BITS[size]
    step = np.diff(x.astype(np.int64), axis=1, prepend=x[:, :1].astype(np.int64))
    step = (step + (1 << w - 1)) % (1 << w) - (1 << w - 1)
    folded = np.where(step < 0, -2 * step - 1, 2 * step)
    blocks = -(-n // block)
    counts = np.full(blocks, block)
    counts[-1] = n - block * (blocks - 1)
    folded = np.pad(folded, ((0, 0), (0, blocks * block - n))).reshape(rows, blocks, block)
    total = folded.sum(axis=2)
    low = _low_bits(total, counts)
    full, zero = low >= FULL_FROM[size], (low == 0) & (total == 0)
    low = np.where(full, 0, low)
    there = np.arange(block) < counts[:, None]
    unary = np.where(there & ~(full | zero)[..., None], folded >> low[..., None], -1)
    width = np.where(full[..., None], w, np.where(zero[..., None], 0, unary + 1 + low[..., None])) * there
    # places of blocks and of samples, each row from a whole byte on
    lengths = code + width.sum(axis=2)
    row_bytes = -(-(w + lengths.sum(axis=1)) // 8)
    begin = 8 * (np.cumsum(row_bytes) - row_bytes)
    block_at = begin[:, None] + w + np.cumsum(lengths, axis=1) - lengths
    at = block_at[..., None] + code + np.cumsum(width, axis=2) - width
    bits = np.zeros(8 * int(row_bytes.sum()), np.uint8)
    _put(bits, begin, x[:, 0].astype(np.int64), np.full(rows, w))
    codes = np.where(full, FULL_FROM[size] + 1, np.where(zero, 0, low + 1))
    _put(bits, block_at.ravel(), codes.ravel(), np.full(codes.size, code))
    whole = there & full[..., None]
    _put(bits, at[whole], folded[whole], np.full(int(whole.sum()), w))
    short = unary >= 0
    bits[at[short] + unary[short]] = 1
    _put(bits, at[short] + unary[short] + 1, folded[short], np.broadcast_to(low[..., None], folded.shape)[short])
    packed = np.packbits(bits).tobytes()
    return [packed[a : a + k] for a, k in zip((begin // 8).tolist(), row_bytes.tolist(), strict=True)]


def decode(streams: list[bytes], n: int, dtype: str, block: int = 32) -> np.ndarray:
    """Streams of ``n`` samples each as rows; one that ends early is an error."""
    kind = np.dtype(dtype)
    w, code, full_code = 8 * kind.itemsize, CODE_BITS[kind.itemsize], FULL_FROM[kind.itemsize] + 1
    out = np.zeros((len(streams), n), np.int64)
    if n == 0 or not streams:
        return out.astype(kind)
    data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    ends = 8 * np.cumsum([len(s) for s in streams])
    words = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))  # eight bytes from each byte on
    ones = np.append(np.flatnonzero(np.unpackbits(data)), 8 * len(data))

    def take(at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        if np.any(at + width > ends):
            raise ValueError("a stream ends before its last sample")
        head = words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        return (head >> np.uint64(1) >> np.asarray(63 - width).astype(np.uint64)).astype(np.int64)

    at = ends - 8 * np.array([len(s) for s in streams])
    last = take(at, w)
    at = at + w
    for start in range(0, n, block):
        codes = take(at, code)
        at = at + code
        low = np.maximum(codes - 1, 0)
        full, short = codes == full_code, (codes > 0) & (codes < full_code)
        for i in range(start, min(start + block, n)):
            one = np.where(short, ones[np.searchsorted(ones, at)], at - 1)  # where the unary part ends
            if np.any(one >= ends):
                raise ValueError("a stream ends before its last sample")
            width = np.where(full, w, np.where(short, low, 0))
            bits_at = one + 1
            value = (np.where(short, one - at, 0) << low * short) | take(bits_at, width)
            at = bits_at + width
            last = last + np.where(value & 1, -(value + 1 >> 1), value >> 1)
            out[:, i] = last
    return (out & (1 << w) - 1).astype(f"u{kind.itemsize}").view(kind)


def _samples(values: np.ndarray, dtype: str) -> np.ndarray:
    x = np.asarray(values).astype(dtype)
    if not np.array_equal(x, values):
        raise ValueError(f"samples that are not {dtype}")
    return x


def rice_compress(data: Column, dtype: str = "long", block: int = 32) -> Column:
    """``(data, size, len)`` of an integer array: its stream, its samples and the stream's bytes.

    A stream longer than the samples and a hundredth is not kept: ``len`` is -1 and ``data`` null.  A null array, or
    one with a missing sample, gives null; an empty one an empty stream.  Samples beyond the type are an error.
    """
    kind = np.dtype(TYPES[dtype])

    @F.pandas_udf("data binary, size long, len long")
    def of(v: pd.Series) -> pd.DataFrame:
        out = [(None, None, None)] * len(v)
        sizes: dict[int, list[int]] = {}
        for k, x in enumerate(v):
            if x is not None:
                sizes.setdefault(len(x), []).append(k)
        for n, at in sizes.items():
            for part in (at[i : i + TOGETHER] for i in range(0, len(at), TOGETHER)):
                most = -(-n * 101 // 100) * kind.itemsize
                for k, s in zip(part, encode(_samples(np.stack([v[k] for k in part]), kind), block), strict=True):
                    out[k] = (s, n, len(s)) if len(s) <= most else (None, n, -1)
        return pd.DataFrame(out, columns=["data", "size", "len"])

    whole = F.when(~F.exists(data, lambda x: x.isNull()), data.cast("array<long>"))
    return F.when(whole.isNotNull(), of(whole))


def rice_expand(data: Column, size: Column, dtype: str = "long", block: int = 32) -> Column:
    """The samples of a stream that ``rice_compress`` or any writer of RICE_1 made; null for a null stream."""
    kind = np.dtype(TYPES[dtype])

    @F.pandas_udf("array<long>")
    def of(streams: pd.Series, n: pd.Series) -> pd.Series:
        out: list = [None] * len(streams)
        sizes: dict[int, list[int]] = {}
        for k, (s, m) in enumerate(zip(streams, n, strict=True)):
            if s is not None and not pd.isna(m):
                sizes.setdefault(int(m), []).append(k)
        for m, at in sizes.items():
            for part in (at[i : i + TOGETHER] for i in range(0, len(at), TOGETHER)):
                for k, x in zip(part, decode([bytes(streams[k]) for k in part], m, kind, block), strict=True):
                    out[k] = x.astype(np.int64)
        return pd.Series(out, dtype=object)

    return of(data, size)
