"""64-bit hashes that Spark lacks, as column expressions that don't overflow under ANSI rules, or in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, 0xFFFFFFFF
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fnv1a(text: Column) -> Column:
    """FNV-1a of a string's UTF-8 bytes, in two 32-bit halves: the prime is 2 ** 40 + 435."""
    raw = F.hex(F.encode(text, "utf-8"))
    bytes_ = F.transform(F.sequence(F.lit(1), F.greatest(F.length(raw) / 2, F.lit(1)).cast("int")), lambda i: F.conv(F.substr(raw, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    start = F.struct(F.lit(OFFSET >> 32).cast("long").alias("hi"), F.lit(OFFSET & MASK).cast("long").alias("lo"))

    def step(s: Column, b: Column) -> Column:
        x = s["lo"].bitwiseXOR(b)
        low = x * 435
        high = s["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(F.lit(MASK).cast("long")).alias("hi"), low.bitwiseAND(F.lit(MASK).cast("long")).alias("lo"))

    whole = F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(bytes_)
    return F.aggregate(whole, start, step, lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"]))


def fnv_sql(text: str) -> str:
    """The same in DuckDB, as UHUGEINT."""
    raw = f"hex(encode({text}))"
    return (
        f"list_reduce(list_prepend({OFFSET}::UHUGEINT, list_transform(range(1, (length({raw}) // 2) + 1), lambda i: ('0x' || substr({raw}, (2 * i - 1)::BIGINT, 2))::INT::UHUGEINT)), "
        f"lambda h, b: (xor(h, b) * {PRIME}::UHUGEINT) % 18446744073709551616::UHUGEINT)"
    )


def fnv1a_many(texts: list[bytes]) -> np.ndarray:
    """FNV-1a of many byte strings at once, a byte place at a time."""
    if not texts:
        return np.zeros(0, dtype=np.uint64)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths)
    return fnv1a_spans(np.frombuffer(b"".join(texts), dtype=np.uint8), ends - lengths, ends)


def fnv1a_spans(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """FNV-1a of many spans of bytes, which may overlap."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    h, begins, left = np.full(len(starts), OFFSET, dtype=np.uint64), starts[order], lengths[order]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))  # those longer than k come first
        h[:n] = (h[:n] ^ flat[begins[:n] + k].astype(np.uint64)) * np.uint64(PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def mix64(x: np.ndarray, golden: bool = True) -> np.ndarray:
    """The splitmix64 finaliser, after its increment if golden."""
    x = x.astype(np.uint64) + np.uint64(GOLDEN if golden else 0)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


def mix_sql(x: str, golden: bool = True) -> str:
    """The same in DuckDB over an UHUGEINT below 2 ** 64."""
    m = "18446744073709551616::UHUGEINT"
    a = f"(({x} + {GOLDEN}::UHUGEINT) % {m})" if golden else f"({x})"
    b = f"((xor({a}, {a} >> 30::UHUGEINT) * {MIX1}::UHUGEINT) % {m})"
    c = f"((xor({b}, {b} >> 27::UHUGEINT) * {MIX2}::UHUGEINT) % {m})"
    return f"xor({c}, {c} >> 31::UHUGEINT)"


def jump(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Jump consistent hash of unsigned keys; fewer than one bucket is one."""
    key, n = keys.astype(np.uint64), max(buckets, 1)
    b, j = np.full(len(key), -1, dtype=np.int64), np.zeros(len(key), dtype=np.int64)
    while (moving := j < n).any():
        b[moving] = j[moving]
        key[moving] = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        j[moving] = ((b[moving] + 1) * (float(1 << 31) / ((key[moving] >> np.uint64(33)) + np.uint64(1)).astype(float))).astype(np.int64)
    return b
