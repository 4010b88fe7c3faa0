"""Vectors as arrays: distances, quantisers, and nearest neighbours.

Kernels over two arrays are higher-order functions; arrays are cast to double. Searches score blocks of rows
against blocks of queries in numpy and keep the best k of each query, so what is shuffled on is k rows for each query
and block. Up to QUERY_BLOCK queries go with the tasks, which then read all rows once where they lie; more
queries, a number that is counted first, meet the rows block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Queries of a block, rows of a block and of one scored at once, rows of a graph.
QUERY_BLOCK, ROW_BLOCK, CHUNK, SEGMENT = 2_048, 16_384, 1_024, 8_192


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def distance(metric: str, a: Column, b: Column) -> Column:
    """Smaller is nearer: l2, or the negated inner product or cosine. Lengths must agree."""
    made = {"l2": l2(a, b), "inner": -dot(a, b), "cosine": -cosine(a, b)}[metric]
    return F.when(F.size(a) == F.size(b), made).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    return F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(doubles(v)))[0]


def embed_cosine(a: Column, b: Column) -> Column:
    """Dot of unit vectors; NaN where lengths differ."""
    return F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.lit(float("nan")))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


def _blocked(df: DataFrame, key: str, size: int, out: str) -> tuple[DataFrame, int]:
    """df with a block number by a hash of its key, and how many blocks of about `size` rows that makes."""
    n = max(1, -(-df.count() // size))
    return df.withColumn(out, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def _kept(ids: np.ndarray, score: Callable[[pd.DataFrame], np.ndarray], batches: Iterator[pd.DataFrame], k: int, key: str) -> pd.DataFrame:
    """The k best rows of each query, ties to the lesser key. score gives a row of distances for each query."""
    keys, kept = np.zeros((len(ids), 0), dtype=np.int64), np.zeros((len(ids), 0))
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.iloc[at : at + CHUNK]
            d = score(part)
            keys, kept = np.hstack([keys, np.broadcast_to(part[key].to_numpy().astype(np.int64), d.shape)]), np.hstack([kept, d])
            best = np.lexsort((keys, kept), axis=1)[:, :k]
            keys, kept = np.take_along_axis(keys, best, axis=1), np.take_along_axis(kept, best, axis=1)
    return pd.DataFrame({"query_id": np.repeat(ids, keys.shape[1]), key: keys.ravel(), "distance": kept.ravel()})


def best_of(rows: DataFrame, queries: DataFrame, k: int, key: str, score: Callable[[pd.DataFrame], Callable[[pd.DataFrame], np.ndarray]]) -> DataFrame:
    """query_id, key, distance, rank of the k best rows for each query. score(queries) gives what scores rows against them."""
    schema = f"query_id long, {key} long, distance double"
    q, n = _blocked(queries.withColumnRenamed(key, "query_id"), "query_id", QUERY_BLOCK, "_q")
    if n == 1:
        few = q.drop("_q").toPandas()  # QUERY_BLOCK rows at most

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if len(few):
                yield _kept(few["query_id"].to_numpy(), score(few), batches, k, key)

        parts = rows.mapInPandas(whole, schema)
    else:
        x, m = _blocked(rows, key, ROW_BLOCK, "_x")
        x = x.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        q = q.withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

        def met(some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(asked):
                return pd.DataFrame({"query_id": [], key: [], "distance": []})
            return _kept(asked["query_id"].to_numpy(), score(asked), iter([some]), k, key)

        parts = x.groupBy("_x", "_q").cogroup(q.groupBy("_x", "_q")).applyInPandas(met, schema)
    window = Window.partitionBy("query_id").orderBy("distance", key)
    return parts.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, key, distance, rank: exact k nearest rows by squared distance, ties to the lesser key."""

    def score(asked: pd.DataFrame) -> Callable[[pd.DataFrame], np.ndarray]:
        q = matrix(asked[embedding])

        def apart(batch: pd.DataFrame) -> np.ndarray:
            x = matrix(batch[embedding])
            return np.stack([((x - row) ** 2).sum(axis=1) for row in q])

        return apart

    return best_of(vectors.select(key, embedding), queries.select(key, embedding), k, key, score)


def scalar_ranges(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """dim, low, scale: (high - low) / 254, 0 for a constant dimension. As many rows as dimensions."""
    each = vectors.select(F.posexplode(embedding).alias("dim", "x")).groupBy("dim").agg(F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"))
    return each.select("dim", "low", ((F.col("high") - F.col("low")) / 254).alias("scale"))


def dimension_arrays(ranges: DataFrame) -> tuple[list[float], list[float]]:
    rows = sorted(ranges.collect(), key=lambda r: r.dim)  # a row for each dimension
    return [r.low for r in rows], [r.scale for r in rows]


def scalar_codes(v: Column, low: list[float], scale: list[float]) -> Column:
    """Codes within -127 and 127; 0 where the scale is 0. Halves round away from zero."""
    params = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(s).alias("scale")) for a, s in zip(low, scale, strict=True)])
    code = F.zip_with(v, params, lambda x, p: F.when(p["scale"] == 0, 0).otherwise(F.greatest(F.least(F.round((x.cast("double") - p["low"]) / p["scale"]) - 127, F.lit(127.0)), F.lit(-127.0))).cast("int"))
    return code


def scalar_decoded(codes: Column, low: list[float], scale: list[float]) -> Column:
    params = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(s).alias("scale")) for a, s in zip(low, scale, strict=True)])
    return F.zip_with(codes, params, lambda c, p: p["low"] + (c + 127) * p["scale"])


def dimension_means(vectors: DataFrame, embedding: str = "embedding") -> list[float]:
    rows = vectors.select(F.posexplode(embedding).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()
    return [r.m for r in sorted(rows, key=lambda r: r.dim)]


def binary_bits(v: Column, means: list[float]) -> Column:
    """A string of 0 and 1, a bit for each component above its dimension's mean; the first dimension is the lowest bit."""
    bits = F.zip_with(v, F.array(*[F.lit(m) for m in means]), lambda x, m: F.when(x.cast("double") > m, "1").otherwise("0"))
    return F.array_join(F.reverse(bits), "")


def binary_code(bits: Column) -> Column:
    """The first 64 bits of a bit string as a long."""
    return F.conv(bits, 2, -10).cast("long")


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """query_id, key: the k nearest of each query by Hamming distance of 64-bit codes (`code`), ties to the lesser key."""

    def score(asked: pd.DataFrame) -> Callable[[pd.DataFrame], np.ndarray]:
        q = asked["code"].to_numpy().astype(np.int64)
        return lambda batch: np.bitwise_count((q[:, None] ^ batch["code"].to_numpy().astype(np.int64)[None, :]).view(np.uint64)).astype(float)

    return best_of(codes.select(key, "code"), queries.select(key, "code"), k, key, score).select("query_id", key)


def product_codebook(vectors: DataFrame, parts: int, centroids: int = 16, rounds: int = 10, key: str = "vec_id", embedding: str = "embedding") -> np.ndarray:
    """parts x centroids x width by Lloyd's rounds, beginning with the least keys' vectors. Each round is one pass of sums."""
    first = [np.asarray(r[0], dtype=float) for r in vectors.orderBy(key).limit(centroids).select(embedding).collect()]
    if not first or len(first[0]) % parts:
        raise ValueError("no sample, or a dimension that the parts don't divide")
    while len(first) < centroids:
        first.append(first[-1])
    book = np.stack(first).reshape(centroids, parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        held = book

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = np.zeros_like(held), np.zeros(held.shape[:2])
            for batch in batches:
                x = np.stack([np.asarray(v, dtype=float) for v in batch[embedding]]).reshape(len(batch), parts, -1)
                codes = product_codes(x, held)
                for p in range(parts):
                    np.add.at(total[p], codes[:, p], x[:, p])
                    n[p] += np.bincount(codes[:, p], minlength=centroids)
            yield pd.DataFrame({"total": [total.ravel()], "n": [n.ravel()]})

        rows = vectors.select(embedding).mapInPandas(sums, "total array<double>, n array<double>").collect()  # a codebook for each task
        total, n = (np.sum([np.asarray(r[i]) for r in rows], axis=0).reshape(s) for i, s in ((0, held.shape), (1, held.shape[:2])))
        book = np.where(n[:, :, None] > 0, total / np.maximum(n, 1)[:, :, None], held)
        if np.allclose(book, held):
            break
    return book


def product_codes(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest centroid in each part, the first of equals. x is rows x parts x width."""
    return np.stack([((x[:, p, None, :] - book[p][None]) ** 2).sum(axis=2).argmin(axis=1) for p in range(book.shape[0])], axis=1)


def product_encoded(vectors: DataFrame, book: np.ndarray, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """key, codes, distortion: squared distance to what the codes stand for."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack([np.asarray(v, dtype=float) for v in batch[embedding]]).reshape(len(batch), book.shape[0], -1)
                codes = product_codes(x, book)
                decoded = np.stack([book[p][codes[:, p]] for p in range(book.shape[0])], axis=1)
                yield pd.DataFrame({key: batch[key], "codes": list(codes), "distortion": ((x - decoded) ** 2).sum(axis=(1, 2))})

    return vectors.select(key, embedding).mapInPandas(encode, f"{key} long, codes array<int>, distortion double")


def asymmetric_top(codes: DataFrame, queries: DataFrame, book: np.ndarray, k: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, key, distance, rank from codes alone: sums of a table of each query's distances to the centroids."""

    def score(asked: pd.DataFrame) -> Callable[[pd.DataFrame], np.ndarray]:
        q = matrix(asked[embedding]).reshape(len(asked), book.shape[0], 1, -1)
        tables = ((q - book[None]) ** 2).sum(axis=3)

        def looked_up(batch: pd.DataFrame) -> np.ndarray:
            c = np.stack(list(batch["codes"]))
            return sum(tables[:, p, :][:, c[:, p]] for p in range(book.shape[0]))

        return looked_up

    return best_of(codes.select(key, "codes"), queries.select(key, embedding), k, key, score)


def graph_index(vectors: DataFrame, links: int = 16, wide: int = 64, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """key, embedding, segment, place, near: every row in the navigable graph of its segment.

    A segment holds some SEGMENT rows, dealt by a hash, in the order of keys (place). A row is linked with its nearest
    among those before it and they with it, each keeping the 2 * links nearest. Build time is linear in segments.
    """
    rows, _ = _blocked(vectors.select(key, embedding), key, SEGMENT, "segment")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key, kind="stable")
        x = matrix(part[embedding])
        near: list[set[int]] = [set() for _ in x]
        for i in range(1, len(x)):
            for j in _best_first(x, near, x[i], wide, i)[:links]:
                near[i].add(j)
                near[j].add(i)
                if len(near[j]) > 2 * links:
                    near[j] = set(sorted(near[j], key=lambda m: ((x[m] - x[j]) ** 2).sum())[: 2 * links])
        return pd.DataFrame({key: part[key], embedding: part[embedding], "segment": part["segment"], "place": np.arange(len(x)), "near": [sorted(n) for n in near]})

    kind = dict(vectors.dtypes)[embedding]
    return rows.groupBy("segment").applyInPandas(build, f"{key} long, {embedding} {kind}, segment int, place int, near array<int>")


def graph_search(graph: DataFrame, queries: DataFrame, k: int, wide: int = 64, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, key, distance, rank: approximate k nearest from a graph_index table, each segment searched best first with `wide` candidates."""
    q, n = _blocked(queries.select(F.col(key).alias("query_id"), F.col(embedding).alias("q")), "query_id", QUERY_BLOCK, "_q")
    count = (graph.agg(F.max("segment")).first()[0] or 0) + 1
    each = graph.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_s", F.col("segment"))
    asked = q.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))

    def search(part: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], key: [], "distance": []})]
        if len(part):
            part = part.sort_values("place")
            x, keys, near = matrix(part[embedding]), part[key].to_numpy(), list(part["near"])
            for i, row in zip(some["query_id"], some["q"], strict=True):
                row = np.asarray(row, dtype=float)
                at = _best_first(x, near, row, max(wide, k), len(x))[:k]
                found.append(pd.DataFrame({"query_id": i, key: keys[at], "distance": ((x[at] - row) ** 2).sum(axis=1)}))
        return pd.concat(found)

    parts = each.groupBy("_s", "_q").cogroup(asked.groupBy("_s", "_q")).applyInPandas(search, f"query_id long, {key} long, distance double")
    window = Window.partitionBy("query_id").orderBy("distance", key)
    return parts.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _best_first(x: np.ndarray, near: list[set[int]], q: np.ndarray, wide: int, n: int) -> list[int]:
    """Places of the nearest found among the first n, from several entries."""
    import heapq

    if not n:
        return []
    seen = set(np.linspace(0, n - 1, min(n, 8)).astype(int).tolist())
    heap = [(float(((x[i] - q) ** 2).sum()), i) for i in seen]
    heapq.heapify(heap)
    best = sorted(heap)
    while heap:
        d, i = heapq.heappop(heap)
        if len(best) >= wide and d > best[wide - 1][0]:
            break
        fresh = [j for j in near[i] if j not in seen and j < n]
        seen.update(fresh)
        if fresh:
            worst = best[-1][0] if len(best) >= wide else float("inf")
            for e, j in zip(((x[fresh] - q) ** 2).sum(axis=1).tolist(), fresh, strict=True):
                if e < worst:
                    heapq.heappush(heap, (e, j))
                    best.append((e, j))
            best = sorted(best)[:wide]
    return [j for _, j in best]
