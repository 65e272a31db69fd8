"""Exact z-order keys of floating-point positions.

A key is a binary string whose bytewise order is the z-order: the dimension with the highest
differing bit decides, the lowest dimension among equals. Bits are those of the fixed-point
magnitude over the exponents that the data occupy; a class per dimension (minus infinity,
negative, positive, infinity) comes first; NaN sorts after everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BitRange:
    """Exponents of the highest and the lowest bit that a key holds."""

    top: int
    low: int

    @property
    def bits(self) -> int:
        return self.top - self.low + 1


@dataclass(frozen=True)
class IntRange:
    """Keys of 64-bit integers: all bits, the sign flipped, so that their order is the numbers'."""

    top: int = 63
    low: int = 0

    @property
    def bits(self) -> int:
        return 64


def bit_range(points: DataFrame, cols: list[str]) -> BitRange | IntRange:
    """The occupied bits of all finite values; one aggregate. None is needed where all are integers."""
    if all(points.schema[c].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") for c in cols):
        return IntRange()
    size = [F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")) & (F.col(c) != 0), F.abs(F.col(c).cast("double"))) for c in cols]
    some = F.array_compact(F.array(*size))
    lo, hi = points.agg(F.min(F.array_min(some)), F.max(F.array_max(some))).first()
    if hi is None:
        return BitRange(0, 0)
    return BitRange(int(np.frexp(hi)[1]) - 1, max(int(np.frexp(lo)[1]) - 53, -1074))


def keys(x: np.ndarray, span: BitRange) -> list[bytes]:
    """Keys of the rows of x (n, dim)."""
    n, dim = x.shape
    x = np.where(x == 0, 0.0, x)
    bad = np.isnan(x).any(axis=1)
    inf = np.isinf(x)
    kind = np.where(inf, np.where(x > 0, 3, 0), np.where(x < 0, 1, 2)).astype(np.uint8)
    finite = np.where(inf | np.isnan(x), 0.0, np.abs(x))
    mantissa, exponent = np.frexp(finite)
    whole = (mantissa * (1 << 53)).astype(np.uint64)
    # whole * 2 ** shift is the magnitude in units of the lowest bit.
    shift = np.where(finite > 0, exponent - 53 - span.low, 0)
    whole = np.where(shift < 0, whole >> np.minimum(-shift, 63).astype(np.uint64), whole)
    shift = np.maximum(shift, 0)
    words = -(-span.bits // 32) + 2
    limbs = np.zeros((n, dim, words), np.uint64)
    at, by = shift // 32, (shift % 32).astype(np.uint64)
    rows, cols = np.indices((n, dim))
    low, high = whole & np.uint64(0xFFFFFFFF), whole >> np.uint64(32)
    for part, step in ((low, 0), (high, 1)):
        moved = part << by
        for piece, more in ((moved & np.uint64(0xFFFFFFFF), 0), (moved >> np.uint64(32), 1)):
            spot = np.minimum(at + step + more, words - 1)
            limbs[rows, cols, spot] |= piece
    big = limbs[:, :, ::-1].astype(">u4").view(np.uint8).reshape(n, dim, words * 4)
    bits = np.unpackbits(big, axis=2)[:, :, words * 32 - span.bits :]
    bits = np.where((kind == 1)[:, :, None], 1 - bits, bits)
    bits = np.where((inf | np.isnan(x))[:, :, None], 0, bits).astype(np.uint8)
    packed = np.packbits(bits.transpose(0, 2, 1).reshape(n, -1), axis=1)
    head = np.concatenate([bad[:, None].astype(np.uint8), np.where(bad[:, None], 0, kind).astype(np.uint8)], axis=1)
    packed[bad] = 0
    both = np.concatenate([head, packed], axis=1)
    return [r.tobytes() for r in both]


def int_keys(x: np.ndarray) -> list[bytes]:
    """Keys of the rows of x (n, dim), 64-bit integers: the bits of x with the sign flipped, interleaved."""
    big = (x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")
    bits = np.unpackbits(np.ascontiguousarray(big).view(np.uint8).reshape(len(x), x.shape[1], 8), axis=2)
    packed = np.packbits(bits.transpose(0, 2, 1).reshape(len(x), -1), axis=1)
    head = np.zeros((len(x), 1 + x.shape[1]), np.uint8)
    return [r.tobytes() for r in np.concatenate([head, packed], axis=1)]


def zkey(cols: list[str], span: BitRange | IntRange) -> Column:
    """The key of the position in cols, as BINARY: a byte that tells NaN, a byte of class per
    dimension, and the interleaved bits."""
    whole = isinstance(span, IntRange)

    @F.pandas_udf("binary")
    def key(x: pd.DataFrame) -> pd.Series:
        return pd.Series(int_keys(x.to_numpy(np.int64)) if whole else keys(x.to_numpy(float), span), dtype=object)

    return key(F.struct(*[F.col(c).cast("long" if whole else "double").alias(c) for c in cols]))


def key_level(a: Column, b: Column, dim: int, span: BitRange | IntRange) -> Column:
    """The level of the smallest node that holds two keys: 0 for equal ones, else one more than the
    number of bits after the first that differs. Keys of different class share no node below the top."""
    head = 1 + dim
    total = dim * span.bits

    @F.pandas_udf("int")
    def level(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.int32)
        for i, (u, v) in enumerate(zip(x, y, strict=True)):
            if u is None or v is None or u == v:
                continue
            if u[:head] != v[:head]:
                out[i] = total + 2 * dim
            else:
                d = int.from_bytes(u[head:], "big") ^ int.from_bytes(v[head:], "big")
                out[i] = d.bit_length() - (8 * (len(u) - head) - total)
        return pd.Series(out)

    return level(a, b)


def key_bits(key: Column, dim: int, span: BitRange) -> Column:
    """A key as a string of 0 and 1: two bits of class per dimension, then dim * span.bits bits."""
    size = dim * span.bits

    @F.pandas_udf("string")
    def text(part: pd.Series) -> pd.Series:
        out = []
        for k in part:
            raw = np.frombuffer(k, np.uint8)
            head = "".join(f"{c:02b}" for c in raw[1 : 1 + dim])
            out.append(head + "".join(map(str, np.unpackbits(raw[1 + dim :])[:size])))
        return pd.Series(out, dtype=object)

    return text(key)
