"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks.

A normalised vector x gets, in each of several tables, a few quantised projections floor((a . x + b) / WIDTH) with a
standard normal and b uniform; vectors that agree on all of a table's share a bucket there. At cosine 0.93 two
vectors lie 0.374 apart and agree on one projection with probability 0.851; at right angles with 0.486. More
projections a table keep unrelated vectors apart, and then more tables are needed: both numbers follow from how
many vectors a label has and from the chance of missing a pair at the threshold, MISS (closer pairs are missed less).

Buckets first compare short codes, some rounded coordinates of the rotated vector, which give a lower bound of the
distance. Only rows that the bound leaves a partner are sent to their buckets again, with their whole vectors, for
the exact cosines; most rows have none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, erf, exp, log, log1p, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quarry.llm.buckets import forest, meet, pairs_of
from quarry.llm.common import materialize, pick
from quarry.llm.components import components

WIDTH, SEED, MISS = 2.0, 20240229, 1e-6
#: What making and sending a row to one table costs, in comparisons of codes.
SEND_COST = 20
#: Coordinates of a code: at least these, and a quarter of all.
CODE, SHARE = 32, 4


def agreement(distance: float, width: float = WIDTH) -> float:
    """The chance that two vectors at this distance agree on one projection."""
    t = width / max(distance, 1e-12)
    return erf(t / sqrt(2)) - 2 / (sqrt(2 * pi) * t) * (1 - exp(-t * t / 2))


def choose(n: float, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(tables, projections in each) for groups of n vectors: the cheapest that miss a pair at the threshold with this chance at most."""
    near, far = agreement(sqrt(max(2 - 2 * threshold, 0.0))), agreement(sqrt(2))
    found = []
    for hashes in range(1, 65):
        tables = max(1, ceil(log(miss) / log1p(-min(near**hashes, 1 - 1e-12))))
        found.append((tables * (SEND_COST + n * far**hashes), tables, hashes))
    return min(found)[1:]


@lru_cache(maxsize=4)
def projections(dim: int, tables: int, hashes: int, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([SEED, dim]))
    return rng.standard_normal((dim, tables * hashes)), rng.uniform(0, width, tables * hashes)


def signatures(unit: np.ndarray, tables: int, hashes: int, width: float = WIDTH) -> np.ndarray:
    """A 64-bit key for each row and table, mixed from the table's quantised projections."""
    a, b = projections(unit.shape[1], tables, hashes, width)
    cells = np.floor((unit @ a + b) / width).astype(np.int64).reshape(len(unit), tables, hashes)
    out = np.broadcast_to(np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(unit), tables)).copy()
    for k in range(hashes):
        out ^= cells[:, :, k].astype(np.uint64)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


@lru_cache(maxsize=16)
def rotation(dim: int) -> np.ndarray:
    """dim x (coordinates of a code) orthonormal columns: what they leave of a difference is never longer than the difference."""
    rng = np.random.Generator(np.random.PCG64([SEED, dim, 1]))
    return np.linalg.qr(rng.standard_normal((dim, min(dim, max(CODE, dim // SHARE)))))[0]


def codes(unit: np.ndarray) -> np.ndarray:
    """Coordinates of the rotated vectors in steps of 1/127."""
    return np.rint(unit @ rotation(unit.shape[1]) * 127).astype(np.int8)


def code_limit(threshold: float, width: int) -> float:
    """The squared distance between codes of `width` coordinates beyond which two vectors can't be at the threshold."""
    return (127 * sqrt(max(2 - 2 * threshold, 0.0)) + sqrt(width) + 1e-6) ** 2  # each of two coordinates is rounded by half a step at most


def _units(raw: pa.ChunkedArray | pa.Array, code: str) -> np.ndarray:
    """Unit vectors in double precision from rows of packed numbers of one length."""
    v = np.frombuffer(b"".join(raw.to_pylist()), dtype=code).astype("f8").reshape(len(raw), -1)
    top = np.abs(v).max(axis=1, keepdims=True)
    v = v / top  # keeps squares of huge or tiny components in range
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def embedding_links(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", embedding: str = "embedding", label: str = "label", miss: float = MISS, width: float = WIDTH) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row.

    Rows are compared when their labels and lengths are equal and the label isn't null; two link when their cosine
    in double precision is the threshold or more. Null and zero vectors, and those with null or non-finite
    components, link with nothing. Rows that repeat a vec_id are vectors of their own. A null vec_id is never the
    least of a component; alone, its component_id and kept are null. Other columns are left out.

    Equal vectors are one with a multiplicity. Each link is counted in the first table where it is found, inside
    the bucket, so no pairs are emitted: a bucket gives its rows' counts and a spanning forest. Whole vectors travel
    in the precision that they have, to the buckets where their codes have a partner; they are compared in double.
    """
    rows = pick(vectors, vec_id=key, embedding=embedding, label=label)
    single = isinstance(rows.schema["embedding"].dataType.elementType, FloatType)
    code = "<f4" if single else "<f8"
    values = F.transform("embedding", lambda x: x.cast("float" if single else "double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), values.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = materialize(rows.withColumn("fit", F.coalesce(fit, F.lit(False))), "vectors")
    groups = rows.where("fit").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    groups = materialize(groups.withColumn("gid", F.monotonically_increasing_id()), "vector-groups")
    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("n")).first()
    tables, hashes = choose(sizes.n or 1.0, threshold, miss)  # from the vectors that share a vector's label, on average

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("gid", pa.int64()), ("code", pa.binary())])
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists, head, gid = batch.column("v"), batch.column("head").to_numpy(), batch.column("gid").to_numpy()
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                for dim in np.unique(sizes).tolist():
                    some = np.flatnonzero(sizes == dim)
                    unit = _units(pa.array([flat[ends[i] - dim : ends[i]].astype(code).tobytes() for i in some], pa.binary()), code)
                    keys = signatures(unit, tables, hashes, width) ^ (head[some] * 31 + dim)[:, None]
                    short = pa.array([x.tobytes() for x in codes(unit)], pa.binary()).take(pa.array(np.repeat(np.arange(len(some)), tables)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(gid[some], tables)), short], schema=schema)

    def near(table: pa.Table, group: np.ndarray | None) -> dict | None:
        """The rows of a bucket whose codes have one near enough."""
        raw, gid, side = table.column("code").to_pylist(), table.column("gid").to_numpy(), table.column("_side").to_numpy()
        if len({len(x) for x in raw}) > 1:
            return _by_length(near, table, group, "code")
        x = np.frombuffer(b"".join(raw), dtype=np.int8).reshape(len(raw), -1).astype(np.float32)
        square, limit = (x * x).sum(axis=1), code_limit(threshold, x.shape[1])
        some = np.zeros(len(x), dtype=bool)
        for i, j in pairs_of(group) if group is not None else ():
            good = (((x[i] - x[j]) ** 2).sum(axis=1) <= limit) & ((side[i] == 2) | (side[i] != side[j]))
            some[i[good]] = some[j[good]] = True
        for at in range(0, len(x) if group is None else 0, 512):
            good = square[at : at + 512, None] + square[None] - 2 * (x[at : at + 512] @ x.T) <= limit
            if side[0] != 2:
                good &= side[at : at + 512, None] != side[None]
            good[np.arange(len(good)), at + np.arange(len(good))] = False
            some |= good.any(axis=0)
        return {"a": table.column("_k").to_numpy()[some], "b": gid[some]} if some.any() else None

    def compare(table: pa.Table, group: np.ndarray | None) -> dict | None:
        gid, copies, cls = (table.column(x).to_numpy() for x in ("gid", "copies", "cls"))
        bucket, side = table.column("_k").to_numpy(), table.column("_side").to_numpy()
        if len({len(x) for x in table.column("raw").to_pylist()}) > 1:
            return _by_length(compare, table, group, "raw")
        unit = _units(table.column("raw"), code)
        if group is not None:
            left, right = (np.concatenate(x) for x in zip(*pairs_of(group), strict=True))
        else:
            left, right = np.nonzero(np.triu(unit @ unit.T >= threshold - 1e-9, 1))
        good = (cls[left] == cls[right]) & ((side[left] == 2) | (side[left] != side[right]))
        left, right = left[good], right[good]
        sure = np.zeros(len(left), dtype=bool)
        for k in range(0, len(left), 20_000):
            sure[k : k + 20_000] = (unit[left[k : k + 20_000]] * unit[right[k : k + 20_000]]).sum(axis=1) >= threshold
        left, right = left[sure], right[sure]
        if not len(left):
            return None
        used, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        keys = signatures(unit[used], tables, hashes, width)
        home = bucket[used] ^ (cls[used] * 31 + unit.shape[1])  # this table's key of each row
        one, two = at[: len(left)], at[len(left) :]
        first = np.empty(len(left), dtype=bool)
        for k in range(0, len(left), 50_000):
            mine = keys[one[k : k + 50_000]]
            same = mine == keys[two[k : k + 50_000]]
            first[k : k + 50_000] = mine[np.arange(len(mine)), same.argmax(axis=1)] == home[one[k : k + 50_000]]
        ends, others = np.concatenate([left[first], right[first]]), np.concatenate([right[first], left[first]])
        n = np.bincount(ends, weights=copies[others], minlength=len(gid)).astype(np.int64)
        root = forest(left, right, len(gid))
        keep = (n > 0) | (root != np.arange(len(gid)))
        return {"a": gid[keep], "b": gid[root[keep]], "n": n[keep]} if keep.any() else None

    slim = groups.select("gid", "v", F.xxhash64("label").alias("head"))
    buckets = materialize(slim.mapInArrow(hashed, "bucket long, gid long, code binary"), "vector-buckets")
    close = meet(buckets, "bucket", near, "a long, b long", block=4096).select(F.col("a").alias("bucket"), F.col("b").alias("gid")).distinct()
    whole = groups.select(F.col("gid").alias("_gid"), "copies", F.xxhash64("label").alias("cls"), "v").mapInArrow(_packed(code), "_gid long, copies long, cls long, raw binary")
    close = materialize(close.join(whole, F.col("gid") == F.col("_gid")).drop("_gid"), "vector-close")
    found = materialize(meet(close, "bucket", compare, "a long, b long, n long", block=1024), "vector-links")
    counts = found.groupBy(F.col("a").alias("gid")).agg(F.sum("n").alias("n"))
    parts = components(found.select("a", "b"))
    named = parts.join(groups.select("gid", "rep"), parts["node"] == F.col("gid")).groupBy("component").agg(F.min("rep").alias("least"))
    named = parts.join(named, "component").select(F.col("node").alias("gid"), "least")
    full = groups.join(counts, "gid", "left").join(named, "gid", "left").select(
        F.col("label").alias("_label"), F.col("v").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("least", "rep").alias("least")
    )
    full = materialize(full, "vector-names")  # both sides of the last join are then plain tables, so a hot vector's rows can be split
    linked = rows.where("fit").join(full, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")))
    linked = linked.select("vec_id", F.col("n").alias("n_links"), F.col("least").alias("component_id"))
    alone = rows.where("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _by_length(compare, table: pa.Table, group: np.ndarray | None, column: str) -> dict | None:
    """compare on the rows of each length by themselves: groups of vectors of several lengths, or two lengths under one key by a collision."""
    lengths = np.asarray([len(x) for x in table.column(column).to_pylist()])
    parts = []
    for n in np.unique(lengths):
        some = lengths == n
        if some.sum() > 1 and (group is None or (np.diff(group[some]) == 0).any()):
            parts.append(compare(table.filter(pa.array(some)), None if group is None else group[some]))
    parts = [x for x in parts if x]
    return {k: np.concatenate([x[k] for x in parts]) for k in parts[0]} if parts else None


def _packed(code: str):
    """Vectors as packed numbers."""
    schema = pa.schema([("_gid", pa.int64()), ("copies", pa.int64()), ("cls", pa.int64()), ("raw", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(code), np.cumsum(np.diff(lists.offsets.to_numpy()))
            raw = [x.tobytes() for x in np.split(flat, ends[:-1])] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("_gid"), batch.column("copies"), batch.column("cls"), pa.array(raw, pa.binary())], schema=schema)

    return pack
