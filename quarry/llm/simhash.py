"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within distance TAU are found by cutting the 64 bits into m parts with thresholds that sum to
TAU - m + 1: two such fingerprints differ in no more than its threshold in at least one part. Correlated bits go to
the same part, so that parts tell fingerprints apart as well as they can; for each number of parts, dynamic
programming over estimated candidate counts allots a threshold of -1 (skip), 0 or more to each, and the
cheapest plan is taken. Each part is probed, and candidates are verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.buckets import grown, meet, pairs_of
from quarry.llm.common import materialize, pick
from quarry.llm.components import components
from quarry.llm.encode import forget

TAU, SHINGLE, SEED = 2, 3, 42
#: Comparisons of fingerprints that cost as much as sending one probe to its bucket; rows of a block of fingerprints.
PROBE_COST, BLOCK = 500, 8192
#: The largest threshold of one part: at 3 a part of 16 bits has 697 probes.
MOST_FLIPS = 3
#: Near-duplicate texts: words of a shingle, least similarity, and the fingerprints' shingles and distance that group
#: them first. Texts at 0.8 differ in some 2 % of words if those are scattered, in up to a fifth if they are one passage.
WORDS, SIMILARITY, FIND_SHINGLE, FIND_TAU = 5, 0.8, 2, 10
#: Hashes of a text's sketch, and the Jaccard similarity of sketches (12 of 32 shared) that makes a candidate of a pair that met.
SKETCH, SKETCHED = 32, 12 / 52
#: Texts of a block that are compared, and the bytes of their shingles.
TEXTS, TEXT_BYTES = 1024, 4 << 20
#: Rows of a block that are compared with all of it at a time.
STRIP = 256
#: Shingles are ordered by how many texts have them, counted in 2 ** LG_SLOTS slots of hashes, in PIECES pieces.
LG_SLOTS, PIECES = 18, 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if over half of the shingles' hashes have it. A-Z are lower-cased; words are split at ASCII blanks."""
    words = _words(text)
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    digest, n = xxhash.xxh64_digest, 0
    totals = np.zeros(64, dtype=np.int64)
    while raw := b"".join([digest(g, SEED) for _, g in zip(range(8192), grams, strict=False)]):
        totals += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(raw) // 8
    return int.from_bytes(np.packbits(2 * totals > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long). Null or wordless text has 0."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), shingle) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.asarray(fps, dtype=np.uint64).view(np.int64))], schema=pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())]))

    rows = pick(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(made, "doc_id long, fp long")


def bits_of(fps: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, bit 0 the lowest."""
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are and, for each two bits, how many have both: 4,096 sums over all of them."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            x = bits_of(batch.column("fp").to_numpy().view(np.uint64)).astype(np.float32)
            total += x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], schema=pa.schema([("n", pa.int64()), ("both", pa.list_(pa.float64()))]))

    made = fps.select("fp").mapInArrow(sums, "n long, both array<double>").select("n", F.posexplode("both").alias("i", "x"))
    rows = made.groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    both = np.zeros(4096)
    for r in rows:
        both[r.i] = r.x
    return (rows[0].n if rows else 0), both.reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of nearly equal size, each part grown from its most correlated bits left."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k) + (len(left) % (parts - k) > 0)
        if k == parts - 1:
            part = left
        else:
            part = [left[int(np.argmax(corr[np.ix_(left, left)].sum(axis=1)))]]
            while len(part) < size:
                rest = [b for b in left if b not in part]
                part.append(rest[int(np.argmax(corr[np.ix_(rest, part)].mean(axis=1)))])
        out.append(sorted(part))
        left = [b for b in left if b not in part]
    return out


def candidates(n: int, both: np.ndarray, part: list[int], threshold: int) -> float:
    """Estimated pairs within the threshold on a part, from all fingerprints' bit shares, and what the probes to find them cost."""
    if threshold < 0:
        return 0.0
    p = np.diag(both)[part] / max(n, 1)
    chance = np.zeros(threshold + 2)
    chance[0] = 1.0
    for d in 2 * p * (1 - p):  # how many bits of the part differ between two at random
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    probes = sum(comb(len(part), t) for t in range(threshold + 1))
    return n * n / 2 * float(chance[: threshold + 1].sum()) + PROBE_COST * n * float(probes)


def allot(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of the parts that sum to total at the least cost, by dynamic programming; an infinite cost if none do."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t, c in part.items():
                if s + t not in step or cost + c < step[s + t][0]:
                    step[s + t] = (cost + c, [*chosen, t])
        best = step
    return best.get(total, (float("inf"), []))


def plan(n: int, both: np.ndarray, tau: int = TAU) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe. More than tau + 1 parts would leave some to skip, as would fewer with longer ones."""
    found = []
    for m in range(2, tau + 4):
        parts = group_bits(n, both, m)
        costs = [{t: candidates(n, both, part, t) for t in range(-1, min(tau, MOST_FLIPS) + 1)} for part in parts]
        found.append((*allot(costs, tau - m + 1), parts))
    cost, thresholds, parts = min(found, key=lambda x: x[0])
    return [(part, t) for part, t in zip(parts, thresholds, strict=True) if t >= 0]


@lru_cache(maxsize=64)
def _flips(bits: tuple[int, ...], threshold: int) -> tuple[int, ...]:
    """Masks that flip up to threshold of these bits, none first."""
    return tuple(sum(1 << b for b in c) for t in range(threshold + 1) for c in combinations(bits, t))


def _probes(rows: DataFrame, parts: list[tuple[list[int], int]], with_fp: bool = False) -> DataFrame:
    """bucket, gid, part, own (and fp): each row of (fp, gid) in its own bucket of every part, and in those that few flips lead to."""
    fields = [("bucket", pa.int64()), ("gid", pa.int64()), ("part", pa.int32()), ("own", pa.bool_())] + [("fp", pa.int64())] * with_fp

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, gid = batch.column("fp").to_numpy().view(np.uint64), batch.column("gid")
            for k, (bits, threshold) in enumerate(parts):
                mask = np.uint64(sum(1 << b for b in bits))
                for flip in _flips(tuple(bits), threshold):
                    key = ((fp & mask) ^ np.uint64(flip)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
                    made = [pa.array(key.view(np.int64)), gid, pa.array(np.full(len(fp), k, np.int32)), pa.array(np.full(len(fp), flip == 0))] + [batch.column("fp")] * with_fp
                    yield pa.RecordBatch.from_arrays(made, schema=pa.schema(fields))

    return rows.select("fp", "gid").mapInArrow(probed, "bucket long, gid long, part int, own boolean" + ", fp long" * with_fp)


def _within(table: pa.Table, group: np.ndarray | None, column: str, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of a bucket that are within tau, of one part, and of which one at least is at home there."""
    x = table.column(column).to_numpy().view(np.uint64)
    own, side, part = table.column("own").to_numpy(), table.column("_side").to_numpy(), table.column("part").to_numpy()

    def near() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if group is not None:
            for a, b in pairs_of(group):
                good = np.bitwise_count(x[a] ^ x[b]) <= tau
                yield a[good], b[good]
            return
        wide = max(1, (1 << 20) // len(x))  # so that a million pairs at most are held
        for at in range(0, len(x), wide):
            a, b = np.nonzero(np.bitwise_count(x[at : at + wide, None] ^ x[None, at:]) <= tau)
            good = a < b
            yield a[good] + at, b[good] + at

    for a, b in near():
        good = (own[a] | own[b]) & (part[a] == part[b]) & ((side[a] == 2) | (side[a] != side[b]))
        yield a[good], b[good]


def links(fps: DataFrame, tau: int = TAU) -> DataFrame:
    """a, b: a spanning forest in each bucket of the pairs of distinct fingerprints (fp) within tau."""
    n, both = bit_statistics(fps)
    if n == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    parts = plan(n, both, tau)

    def compare(table: pa.Table, group: np.ndarray | None) -> dict | None:
        fp = table.column("gid").to_numpy()
        root = np.arange(len(fp))
        for left, right in _within(table, group, "gid", tau):
            root = grown(root, left, right)
        keep = (root != np.arange(len(fp))) & (fp[root] != fp)
        return {"a": fp[keep], "b": fp[root[keep]]} if keep.any() else None

    rows = _probes(fps.select("fp", F.col("fp").alias("gid")), parts)
    return meet(materialize(rows, "simhash-probes"), "bucket", compare, "a long, b long", block=BLOCK)


def loosest(n: int, both: np.ndarray, most: int = FIND_TAU, least: int = TAU) -> int:
    """The largest distance from least to most at which a fingerprint has less than one of n others by chance."""
    p = np.diag(both) / max(n, 1)
    chance = np.zeros(most + 2)
    chance[0] = 1.0
    for d in 2 * p * (1 - p):
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    met = n * np.cumsum(chance)[: most + 1]
    return max([t for t in range(least, most + 1) if met[t] < 1], default=least)


def partners(texts: DataFrame, most: int = FIND_TAU) -> DataFrame:
    """bucket, gid: the rows of texts (gid, fp) that have another within the distance in a bucket. Each pair is told by one bucket,
    that of the first part that brings it together, where the lesser fingerprint is at home."""
    n, both = bit_statistics(texts)
    if n == 0:
        return texts.select(F.col("gid").alias("bucket"), "gid")
    tau = loosest(n, both, most)
    parts = plan(n, both, tau)
    masks = [(np.uint64(sum(1 << b for b in bits)), t) for bits, t in parts]

    def compare(table: pa.Table, group: np.ndarray | None) -> dict | None:
        x, gid = table.column("fp").to_numpy().view(np.uint64), table.column("gid").to_numpy()
        own, part = table.column("own").to_numpy(), table.column("part").to_numpy()
        some = np.zeros(len(x), dtype=bool)
        for a, b in _within(table, group, "fp", tau):
            if not len(a):
                continue
            d = x[a] ^ x[b]
            first, away = np.full(len(a), -1), np.zeros(len(a), dtype=bool)
            for k, (mask, t) in reversed(list(enumerate(masks))):
                differ = np.bitwise_count(d & mask)
                first[differ <= t] = k
                away[(part[a] == k) & (differ > 0)] = True
            told = (first == part[a]) & (~away | np.where(x[a] < x[b], own[a], own[b]))
            some[a[told]] = some[b[told]] = True
        return {"a": table.column("_k").to_numpy()[some], "b": gid[some]} if some.any() else None

    rows = materialize(_probes(texts, parts, with_fp=True), "simhash-probes")
    found = meet(rows, "bucket", compare, "a long, b long", block=BLOCK)
    return found.select(F.col("a").alias("bucket"), F.col("b").alias("gid")).distinct()


def near_duplicates(docs: DataFrame, tau: int = TAU, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id reachable by links): a row for each row.

    Equal fingerprints are one node, however many documents share it. Null, empty and wordless texts have
    fingerprint 0 and link like any other. A null doc_id is never the least unless all of its component are null.
    Other columns are left out. Whole texts count, in chunks of 8,192 shingles.
    """
    found = materialize(fingerprints(docs, key, text, shingle), "fingerprints")
    nodes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    parts = components(links(nodes, tau))
    low = parts.join(nodes, parts["node"] == nodes["fp"]).groupBy("component").agg(F.min("least").alias("low"))
    named = parts.join(low, "component").select(F.col("node").alias("_node"), "low")
    full = nodes.join(named, nodes["fp"] == named["_node"], "left").select(F.col("fp").alias("_fp"), F.coalesce("low", "least").alias("component_id"))
    full = materialize(full, "fingerprint-names")  # both sides of the last join are then plain tables, so a hot fingerprint's rows can be split
    joined = found.join(full, found["fp"] == full["_fp"])
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def copies_of(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, fp (of FIND_SHINGLE-word shingles, each once), sketch (the SKETCH least hashes of shingles), short (their low 16 bits) and key, equal where the lower-cased words are."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64()), ("key", pa.binary()), ("sketch", pa.binary()), ("short", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes = _Hashes()
        for part in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            each = [_words(x.as_py()) for x in part.column("text")]
            fps = np.asarray([_majority(_tokens(w, min(FIND_SHINGLE, len(w)), hashes)) for w in each], dtype=np.uint64).view(np.int64)
            sketches = [_tokens(w, words, hashes)[:SKETCH] for w in each]
            made = (fps, [_key(w) for w in each], [x.tobytes() for x in sketches], [x.astype("<u2").tobytes() for x in sketches])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *[pa.array(x, type=f.type) for x, f in zip(made, list(schema)[2:], strict=True)]], schema=schema)

    return rows.mapInArrow(read, "doc_id long, text_hash long, fp long, key binary, sketch binary, short binary")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _majority(hashes: np.ndarray) -> int:
    """64 bits, each set if over half of the hashes have it; 0 of none."""
    return int(np.packbits(2 * bits_of(hashes).sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word, SEED)
        return made


def _tokens(words: list[bytes], n: int, hashes: _Hashes) -> np.ndarray:
    """The distinct shingles of n words as 64-bit hashes made from the words' own, ascending; none if there are fewer words."""
    if len(words) < max(n, 1):
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    last = len(words) - n + 1
    out = each[:last].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + each[k : last + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def slot_counts(rows: DataFrame, words: int) -> np.ndarray:
    """How many texts have the shingles of each slot: 2 ** LG_SLOTS sums, whatever the corpus holds."""
    shift, wide = np.uint64(64 - LG_SLOTS), (1 << LG_SLOTS) // PIECES
    schema = pa.schema([("piece", pa.int32()), ("n", pa.binary())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes, total = _Hashes(), np.zeros(1 << LG_SLOTS, dtype=np.int64)
        for batch in batches:
            for x in batch.column("text"):
                slots = (_tokens(_words(x.as_py()), words, hashes) >> shift).astype(np.int64)
                if len(slots):
                    np.add.at(total, slots, 1)
        if total.any():
            yield pa.RecordBatch.from_pydict({"piece": np.arange(PIECES, dtype=np.int32), "n": [x.tobytes() for x in total.reshape(PIECES, wide)]}, schema=schema)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("piece").to_pylist(), batch.column("n").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, dtype=np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"piece": list(sums), "n": [x.tobytes() for x in sums.values()]}, schema=schema)

    out = np.zeros((PIECES, wide), dtype=np.int64)
    parts = rows.select("text").mapInArrow(counted, "piece int, n binary").repartition(PIECES, "piece").mapInArrow(summed, "piece int, n binary")
    for r in parts.collect():
        out[r.piece] = np.frombuffer(r.n, dtype=np.int64)
    return np.minimum(out.ravel(), 2**32 - 1).astype(np.uint32)


def rare_tokens(rows: DataFrame, similarity: float, words: int) -> DataFrame:
    """token, gid (of the text's words), n, pos: those of each text's rarest shingles that another text has among its own.

    By prefix filtering: in any order common to all, two sets with this similarity share one of their first
    n - ceil(similarity n) + 1. Rare shingles come first, so that common passages bring few texts together.
    """
    counts, shift = slot_counts(rows, words), np.uint64(64 - LG_SLOTS)
    schema = pa.schema([("token", pa.int64()), ("gid", pa.int64()), ("at", pa.int64())])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                for x in batch.column("text").slice(at, 256):
                    w = _words(x.as_py())
                    tokens = _tokens(w, words, hashes)
                    n = len(tokens)
                    if n:
                        first = n - int(np.ceil(similarity * n - 1e-6)) + 1
                        tokens = tokens[np.argsort(counts[(tokens >> shift).astype(np.int64)], kind="stable")[:first]]
                        who = int.from_bytes(_key(w)[:8], "big", signed=True)
                        out.append((tokens.view(np.int64), np.full(len(tokens), who), (n << 32) + np.arange(len(tokens), dtype=np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=schema)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by token, then gid; a row is held back until the next is known."""
        held = np.empty((3, 0), dtype=np.int64)
        before = None  # the token of the row before the one held

        def cut(x: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, before
            new = np.ones(x.shape[1], dtype=bool)
            new[1:] = (x[:2, 1:] != x[:2, :-1]).any(axis=0)
            x = x[:, new]
            same = x[0, 1:] == x[0, :-1]
            keep = np.zeros(x.shape[1], dtype=bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= x[0, 0] == before
            end = x.shape[1] if last else x.shape[1] - 1
            held = x[:, end:]
            if end:
                before = x[0, end - 1]
            if keep[:end].any():
                yield pa.RecordBatch.from_arrays([pa.array(c[:end][keep[:end]]) for c in x], schema=schema)

        for batch in batches:
            if batch.num_rows:
                yield from cut(np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in schema.names])], axis=1), False)
        if held.shape[1]:
            yield from cut(held, True)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = rows.select("text").mapInArrow(prefixes, "token long, gid long, at long").repartition(n, "token").sortWithinPartitions("token", "gid")
    found = made.mapInArrow(shared, "token long, gid long, at long")
    return materialize(found.select("token", "gid", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos")), "rare-tokens")


def _overlaps(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many hashes each two of several sets share; the sets lie one after another, `sizes` long. Filled for i before j, STRIP rows at a time."""
    n = len(sizes)
    order = np.argsort(hashes)
    hashes, row = hashes[order], np.repeat(np.arange(n, dtype=np.int32), sizes)[order]
    del order
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    del hashes
    shared = ~new  # the first of several equal ones counts too
    shared[:-1] |= ~new[1:]
    row, inverse = row[shared], np.cumsum(new[shared], dtype=np.int32) - 1
    del new, shared
    both = np.zeros((n, n), dtype=np.float32)
    width, k, at = max(256, (4 << 20) // n), int(inverse[-1]) + 1 if len(inverse) else 0, 0
    for first in range(0, k, width):
        end = int(np.searchsorted(inverse, first + width))
        has = np.zeros((n, min(width, k - first)), dtype=np.float32)
        has[row[at:end], inverse[at:end] - first] = 1
        for i in range(0, n, STRIP):
            both[i : i + STRIP, i:] += has[i : i + STRIP] @ has[i:].T
        at = end
    return both


def token_links(tokens: DataFrame, similarity: float) -> DataFrame:
    """a, b: texts of two groups that share a token and may be similar by their sizes, the token's places, and SKETCHED of their sketches.

    tokens has token, gid, n, pos, bucket (the text's group) and sh, the low 16 bits of its sketch. A spanning forest
    in each two blocks of a token's rows; never the pairs.
    """
    share = similarity / (1 + similarity)

    def compare(table: pa.Table, group: np.ndarray | None) -> dict | None:
        bucket, side, gid = table.column("bucket").to_numpy(), table.column("_side").to_numpy(), table.column("gid").to_numpy()
        if (bucket == bucket[0]).all():
            return None
        n, pos, raw = table.column("n").to_numpy(), table.column("pos").to_numpy(), table.column("sh").to_pylist()
        rest, sizes, values = n - pos, np.asarray([len(x) // 2 for x in raw]), np.frombuffer(b"".join(raw), dtype="<u2")

        def may(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            good = (bucket[a] != bucket[b]) & ((side[a] == 2) | (side[a] != side[b])) & (np.minimum(rest[a], rest[b]) >= share * (n[a] + n[b]) - 1e-6)
            return good & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-6)

        root = np.arange(len(gid))
        if group is not None:
            each = np.full((len(n), SKETCH), -1, dtype=np.int32)
            each[np.arange(SKETCH) < sizes[:, None]] = values
            for a, b in pairs_of(group):
                good = may(a, b)
                a, b = a[good], b[good]
                for k in range(0, len(a), 4096):
                    x, y = a[k : k + 4096], b[k : k + 4096]
                    same = ((each[x][:, :, None] == each[y][:, None, :]) & (each[x] >= 0)[:, :, None]).any(axis=2).sum(axis=1)
                    near = same >= SKETCHED * (sizes[x] + sizes[y] - same) - 1e-6
                    root = grown(root, x[near], y[near])
        else:
            every, both = np.arange(len(n)), _overlaps(values, sizes)
            for at in range(0, len(n), STRIP):
                some = both[at : at + STRIP]
                good = np.triu(some >= SKETCHED * (sizes[at : at + STRIP, None] + sizes[None] - some) - 1e-6, at + 1)
                good &= root[at : at + STRIP, None] != root[None]
                a, b = np.nonzero(good & may(every[at : at + STRIP, None], every[None]))
                root = grown(root, a + at, b)
        keep = root != np.arange(len(gid))
        return {"a": gid[keep], "b": gid[root[keep]]} if keep.any() else None

    return meet(tokens, "token", compare, "a long, b long", block=TEXTS)


def sketch_links(found: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: of the texts (gid) that met in a bucket, those that SKETCHED of their sketches' hashes tell to be near copies, perhaps.

    A sketch is the SKETCH least hashes of a text's shingles, so two at similarity 0.8 share 25.6 of 32 on average,
    and fewer than 12 with a chance of 1.5e-7; those that met by accident share none or few.
    """
    rows = found.join(classes.select(F.col("gid").alias("_gid"), F.col("sketch").alias("sh")), F.col("gid") == F.col("_gid"))
    rows = rows.select("bucket", "gid", "sh", F.floor(F.length("sh") / F.lit(8)).cast("long").alias("n")).where("n > 0")
    return similar_links(rows, SKETCHED, block=BLOCK // 4)


def similar_links(texts: DataFrame, similarity: float = SIMILARITY, block: int | None = None) -> DataFrame:
    """a, b: a spanning forest, in each two blocks of a bucket, of the pairs of gid whose sets of hashes (sh, n of them) have this Jaccard similarity."""

    def compare(table: pa.Table, group: np.ndarray | None) -> dict | None:
        gid, side = table.column("gid").to_numpy(), table.column("_side").to_numpy()
        raw = table.column("sh").to_pylist()
        sizes = np.asarray([len(x) // 8 for x in raw])
        hashes = np.frombuffer(b"".join(raw), dtype="<u8")
        del raw
        both = _overlaps(hashes, sizes)
        del hashes
        root = np.arange(len(gid))
        for at in range(0, len(gid), STRIP):
            some = both[at : at + STRIP]
            good = np.triu(some >= similarity * (sizes[at : at + STRIP, None] + sizes[None, :] - some) - 1e-6, at + 1)
            good &= root[at : at + STRIP, None] != root[None, :]
            if side[0] != 2:
                good &= side[at : at + STRIP, None] != side[None, :]
            left, right = np.nonzero(good)
            root = grown(root, left + at, right)
        keep = root != np.arange(len(gid))
        return {"a": gid[keep], "b": gid[root[keep]]} if keep.any() else None

    return meet(texts.select("bucket", "gid", "sh", "n"), "bucket", compare, "a long, b long", block=block or TEXTS, weight="n", most=TEXT_BYTES // 8, small=0)


def near_duplicate_texts(docs: DataFrame, tau: int = FIND_TAU, similarity: float = SIMILARITY, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, component_id, kept: a row for each row. Texts link whose `words`-word shingles have this similarity or more.

    Fingerprints within a distance bring texts together first: at most tau, less where so many texts would meet
    others by chance. Then texts of two groups meet wherever they share one of their rarest shingles and may be
    similar, as any two that are must (rare_tokens), so that no edit hides a copy from the fingerprints. Those that
    met are verified twice: by sketches, before any grouping, so that chance meetings don't chain unrelated texts
    together, and inside the groups that are left by whole sets of shingles, so that no link is false.

    Texts with the same lower-cased words are one text, empty, wordless and null ones included. component_id is the
    least doc_id reachable by links, never null unless all of a component are. kept marks one text of each component:
    the least by doc_id (null last), then by text_hash; rows that repeat both are marked alike. Other columns are left out.
    """
    rows = pick(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    found = materialize(copies_of(rows, words), "copies")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = found.groupBy("fp", "key").agg(F.min(first).alias("first"), F.min("sketch").alias("sketch"), F.min("short").alias("short"))
    classes = materialize(classes.withColumn("gid", F.monotonically_increasing_id()), "copy-classes")
    near = materialize(sketch_links(partners(classes, tau), classes), "near-links")
    groups = components(near)
    placed = classes.join(groups, classes["gid"] == groups["node"], "left").select("gid", "key", F.coalesce("component", "gid").alias("bucket"), "short")
    who = placed.select(F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long").alias("_who"), F.col("gid").alias("_gid"), "bucket", F.col("short").alias("sh"))
    tokens = rare_tokens(rows, similarity, words)
    tokens = tokens.join(who.drop("sh"), tokens["gid"] == who["_who"]).select("token", F.col("_gid").alias("gid"), "n", "pos", "bucket")
    tokens = materialize(tokens, "copy-tokens")
    several = tokens.groupBy("token").agg(F.min("bucket").alias("_low"), F.max("bucket").alias("_high")).where("_low < _high").select("token")
    tokens = tokens.join(several, "token", "left_semi").join(who.select(F.col("_gid").alias("gid"), "sh"), "gid")
    near = near.unionByName(materialize(token_links(materialize(tokens, "mixed-tokens"), similarity), "near-links"))
    groups = components(near)
    placed = classes.join(groups, classes["gid"] == groups["node"])
    wanted = placed.select("gid", F.col("key").alias("want"), F.col("first.doc_id").alias("_doc"), F.col("first.text_hash").alias("_th"), F.col("component").alias("bucket"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("gid", pa.int64()), ("sh", pa.binary()), ("n", pa.int64())])
        hashes = _Hashes()
        for batch in batches:
            bucket, gid, want = (batch.column(x).to_pylist() for x in ("bucket", "gid", "want"))
            for at in range(0, batch.num_rows, 512):
                out: list[tuple] = []
                for i, x in enumerate(batch.column("text").slice(at, 512), at):
                    w = _words(x.as_py())
                    if _key(w) == want[i]:
                        sh = _tokens(w, words, hashes)
                        out.append((bucket[i], gid[i], sh.tobytes(), len(sh)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    # one row's text stands for its class; rows that repeat it bring it again
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["_doc"]) & (rows["text_hash"] == wanted["_th"])).select("text", "want", "bucket", "gid")
    texts = materialize(texts.mapInArrow(cut, "bucket long, gid long, sh binary, n long").dropDuplicates(["gid"]), "copy-texts")
    parts = components(similar_links(texts, similarity))
    low = parts.join(classes, parts["node"] == classes["gid"]).groupBy("component").agg(F.min("first").alias("low"))
    named = parts.join(low, "component").select(F.col("node").alias("_node"), "low")
    full = classes.join(named, classes["gid"] == named["_node"], "left").select(F.col("fp").alias("_fp"), F.col("key").alias("_key"), F.coalesce("low", "first").alias("low"))
    full = materialize(full, "copy-names")
    joined = found.join(full, (found["fp"] == full["_fp"]) & (found["key"] == full["_key"]))
    kept = F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("text_hash") == F.col("low.text_hash"))
    return joined.select("doc_id", "text_hash", F.col("low.doc_id").alias("component_id"), kept.alias("kept"))
