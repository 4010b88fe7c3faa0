"""Exact and SimHash duplicates, and leader clustering in arrival order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import fnv1a_spans, signed
from quarry.functions.text import shingle_words
from quarry.operators.ordered import shared_table

THRESHOLD, BANDS = 3, 5
#: Shingles that are hashed at once, and documents whose shingles are counted at once.
PIECE, SLICE = 65_536, 64


def exact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """hash, kept (the least key), copies."""
    return docs.groupBy(F.sha2(F.col(text), 256).alias("hash")).agg(F.min(key).alias("kept"), F.count(F.lit(1)).alias("copies"))


def fingerprints(docs: DataFrame, k: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp: a bit is set if the weights of shingles whose FNV-1a hash has it exceed those without. Empty text gives 0.

    Words come joined by blanks, and a shingle is a span of that text, so it is never made; a task holds one batch of
    texts, and the hashes of PIECE shingles, which go byte place by byte place in numpy.
    """
    k = max(k, 1)

    def bits_of(raw: bytes) -> tuple[np.ndarray, int]:
        flat = np.frombuffer(raw, dtype=np.uint8)
        blanks = np.flatnonzero(flat == 32)
        starts, ends = np.r_[0, blanks + 1], np.r_[blanks, len(flat)]
        if len(starts) >= k:
            starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        total = np.zeros(64, dtype=np.int64)
        for at in range(0, len(starts), PIECE):
            h = fnv1a_spans(flat, starts[at : at + PIECE], ends[at : at + PIECE])
            total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return total, len(starts)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.int64)
            for i, text in enumerate(batch.column(1)):
                if raw := (text.as_py() or "").encode():
                    bits, n = bits_of(raw)
                    out[i] = np.packbits(2 * bits > n, bitorder="little").view("<i8")[0]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out)], names=[key, "fp"])

    return docs.select(key, F.array_join(shingle_words(F.col(text)), " ").alias("words")).mapInArrow(made, f"{key} long, fp long")


def shingle_counts(docs: DataFrame, k: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, gram, n of each document's shingles, counted text by text where they are read; only keys that repeat are brought together by a shuffle."""
    k = max(k, 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, found = batch.slice(at, SLICE), []
                for words in part.column(1).to_pylist():
                    words = words.split(" ") if words else []
                    found.append(Counter(map(" ".join, zip(*[words[i:] for i in range(k)]))) if len(words) >= k else Counter([" ".join(words)] if words else []))  # noqa: B905
                rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()).take(rows), pa.array([g for x in found for g in x], pa.string()), pa.array([n for x in found for n in x.values()], pa.int64())], names=[key, "gram", "n"])

    each = docs.select(key, F.array_join(shingle_words(F.col(text)), " ").alias("words")).mapInArrow(counted, f"{key} long, gram string, n long")
    if docs.groupBy(key).count().where("count > 1").isEmpty():
        return each
    return each.groupBy(key, "gram").agg(F.sum("n").alias("n"))


def classes(fps: DataFrame, key: str = "doc_id") -> DataFrame:
    """fp, first: each distinct fingerprint and its least document."""
    return fps.groupBy("fp").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"))


def near_pairs(found: DataFrame, threshold: int = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """a < b (first documents), f and g (their fingerprints), distance of all pairs of classes within the threshold.

    Of `bands` bands of bits, any two such fingerprints agree on all but `threshold`, so they agree on some choice
    of that many bands; each choice is a key of an equi-join. With five bands a key has 25 bits or more, so that
    buckets stay small where single bands would not. Copies aren't paired: they are one class.
    """
    edges = [64 * i // bands for i in range(bands + 1)]
    masks = [sum(1 << b for i in choice for b in range(edges[i], edges[i + 1])) for choice in combinations(range(bands), bands - threshold)]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for i, m in enumerate(masks)])
    each = found.select("fp", "first", F.explode(keys).alias("x")).select("fp", "first", "x.choice", "x.value")
    met = each.alias("l").join(each.alias("r"), (F.col("l.choice") == F.col("r.choice")) & (F.col("l.value") == F.col("r.value")) & (F.col("l.first") < F.col("r.first")))
    differ = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    distance, first = F.bit_count(differ), F.lit(None).cast("int")
    for i, m in reversed(list(enumerate(masks))):  # a pair is told by the first choice that both agree on, and so once
        first = F.when(differ.bitwiseAND(F.lit(signed(m))) == 0, F.lit(i)).otherwise(first)
    met = met.where((distance <= threshold) & (first == F.col("l.choice")))
    return met.select(F.col("l.first").alias("a"), F.col("r.first").alias("b"), F.col("l.fp").alias("f"), F.col("r.fp").alias("g"), distance.cast("long").alias("distance"))


def leaders(fps: DataFrame, threshold: int = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """key, leader: in the order of keys, a document joins the nearest leader before it (the lesser of equals) within the threshold, or leads.

    Only first documents of classes can lead. One does if no leader is among its earlier neighbours; rounds settle
    those whose earlier neighbours are all settled or who have a leader there, as many as the longest chain. Then
    each document takes the nearest of its class's leaders that comes before it.
    """
    found = shared_table(classes(fps, key), "classes")
    pairs = shared_table(near_pairs(found, threshold), "near")
    earlier = pairs.select(F.col("b").alias("node"), F.col("a").alias("before"))
    nodes = found.select(F.col("first").alias("node"))
    state = shared_table(nodes.join(earlier.select("node").distinct(), "node", "left_anti").select("node", F.lit(True).alias("leads")), "state")
    total = nodes.count()
    while state.count() < total:
        open_ = nodes.join(state, "node", "left_anti")
        known = earlier.join(open_, "node").join(state.select(F.col("node").alias("before"), "leads"), "before", "left")
        settled = known.groupBy("node").agg(F.coalesce(F.bool_or("leads"), F.lit(False)).alias("led"), F.bool_and(F.col("leads").isNotNull()).alias("all"))
        state = shared_table(state.unionByName(settled.where("led OR all").select("node", (~F.col("led")).alias("leads"))), "state")
    lead = state.where("leads").select(F.col("node").alias("leader"))
    own = found.select("fp", F.col("first").alias("leader"), F.lit(0).cast("long").alias("distance"))
    near = pairs.select(F.col("f").alias("fp"), F.col("b").alias("leader"), "distance").unionByName(pairs.select(F.col("g").alias("fp"), F.col("a").alias("leader"), "distance"))
    choices = own.unionByName(near).join(lead, "leader")
    met = fps.join(choices, "fp").where(F.col("leader") <= F.col(key))
    return met.groupBy(key).agg(F.min(F.struct("distance", "leader")).alias("x")).select(key, "x.leader")
