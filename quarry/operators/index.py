"""Inverted index: postings, dictionary, blocks, segments and retrieval, as relational plans.

Postings are (doc_id, term, tf) rows. seal() writes them once as lists, a row of arrays for each block of a term, sorted by
(term, block), with the dictionary and the stored fields beside them. In Parquet so sorted, row-group and page statistics do what skip lists do:
a lookup, a prefix or a query's terms are pushed filters, and nothing else of the lists is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import index_terms
from quarry.operators.ordered import shared_table

#: Postings of a block, document ids of a span, and documents that Python counts at once.
BLOCK, SPAN, SLICE = 128, 65_536, 64
LISTED = ["term", "block", "docs", "tfs", "gaps", "first_doc", "last_doc", "max_tf", "cf", "n", "partial"]


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, term, tf. Counts combine before the shuffle."""
    return docs.select(F.col(key).alias("doc_id"), F.explode(index_terms(F.col(text))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def dictionary(posts: DataFrame) -> DataFrame:
    """term, df, cf, max_tf, singleton."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf")).withColumn("singleton", F.col("df") == 1)


def lookup(terms: DataFrame, *wanted: str) -> DataFrame:
    return terms.where(F.col("term").isin(*wanted))


def prefix_scan(terms: DataFrame, prefix: str) -> DataFrame:
    return terms.where(F.col("term").startswith(prefix)).orderBy("term")


def numbered(df: DataFrame, group: list[str], key: str, out: str, span: int = SPAN) -> DataFrame:
    """Places from 0 by key within a group, counted in spans of keys, so that no task sorts a whole hot group."""
    spans = df.withColumn("_span", F.floor(F.col(key) / F.lit(span)))
    before = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    counts = spans.groupBy(*group, "_span").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*group, "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_span").orderBy(key)
    return spans.withColumn("_at", F.row_number().over(inside) - 1).join(starts, [*group, "_span"]).withColumn(out, (F.col("_before") + F.col("_at")).cast("long")).drop("_span", "_at", "_before")


def summed_before(df: DataFrame, group: list[str], key: str, value: Column, out: str, span: int = SPAN) -> DataFrame:
    """The sum of value over the rows of a group before each by key, in spans of keys as numbered() does."""
    spans = df.withColumns({"_span": F.floor(F.col(key) / F.lit(span)), "_value": value})
    order = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    totals = spans.groupBy(*group, "_span").agg(F.sum("_value").alias("_total"))
    starts = totals.select(*group, "_span", F.coalesce(F.sum("_total").over(order), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_span").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    found = spans.withColumn("_sum", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(starts, [*group, "_span"])
    return found.withColumn(out, F.col("_start") + F.col("_sum")).drop("_span", "_value", "_sum", "_start")


def blocks(posts: DataFrame, size: int = BLOCK) -> DataFrame:
    """term, block, first_doc, last_doc, max_tf, n: the lists cut into blocks of `size` postings in document order."""
    placed = numbered(posts, ["term"], "doc_id", "_place").withColumn("block", F.floor(F.col("_place") / F.lit(size)).cast("long"))
    return placed.groupBy("term", "block").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.max("tf").alias("max_tf"), F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Sealed:
    """An index in a folder. lists (a row for each block of a term), and so postings and blocks, and dictionary are sorted by term, stored by doc_id."""

    spark: SparkSession
    path: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def lists(self) -> DataFrame:
        """term, block, docs, tfs and gaps (arrays in document order, the first gap from the document before the block, or 0), first_doc, last_doc, max_tf, cf, n."""
        return self._table("lists").where("partial = false").drop("partial").unionByName(self._table("seams"))

    @property
    def postings(self) -> DataFrame:
        rows = self.lists.select("term", "block", F.inline_outer(F.arrays_zip("docs", "tfs")).alias("doc_id", "tf"))  # no list is empty
        return rows.select("term", "doc_id", "tf", "block")

    @property
    def dictionary(self) -> DataFrame:
        return self._table("dictionary")

    @property
    def blocks(self) -> DataFrame:
        return self.lists.select("term", "block", "first_doc", "last_doc", "max_tf", "cf", "n")

    @property
    def stored(self) -> DataFrame:
        """doc_id, local (dense from 0 in the order of doc_id), length (terms), norm (length up to 65,535), and the fields kept."""
        rows = self._table("stored").join(F.broadcast(self._table("starts")), "_range")  # a row for each range
        return rows.withColumn("local", F.col("_start") + F.col("_at")).drop("_range", "_start", "_at")


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """postings() in the order of docs: each text is counted where it is read, so nothing is shuffled unless keys repeat."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [Counter(x.split(" ")) for x in part.column(1).to_pylist()]
                for each in found:
                    each.pop("", None)
                sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
                ids = np.repeat(part.column(0).to_numpy(), sizes)
                terms, tfs = [t for each in found for t in each], [n for each in found for n in each.values()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], names=["doc_id", "term", "tf"])

    flat = F.coalesce(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", " "), F.lit(""))
    each = docs.select(F.col(key).cast("long").alias("doc_id"), flat.alias("text")).where("doc_id IS NOT NULL").mapInArrow(counted, "doc_id long, term string, tf long")
    if docs.groupBy(key).count().where(F.col(key).isNotNull() & (F.col("count") > 1)).isEmpty():
        return each
    return each.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))


def _blocked(size: int):
    """Rows (term, doc_id, tf, before, last) in order to rows of lists. Where a term is dealt over tasks, before and last tell how many of its
    postings come before a row's bucket, and the last document of those. What a task's first and last block of such a term may lack is in another task: it is partial."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, doc = None, 0, 0  # rows of the block that goes on, its first row's place and the document before

        def cut(rows: pa.Table, final: bool):
            nonlocal held, place, doc
            terms = rows.column("term").combine_chunks()
            codes = terms.dictionary_encode().indices.to_numpy()
            docs, tfs = rows.column("doc_id").to_numpy(), rows.column("tf").to_numpy()
            dealt = rows.column("before").is_valid().to_numpy()
            m = len(docs)
            new = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            before = rows.column("before").fill_null(0).to_numpy()[new].copy()
            last = rows.column("last").fill_null(0).to_numpy()[new].copy()
            if held is not None and held.num_rows:
                before[0], last[0] = place, doc
            runs = np.diff(np.r_[new, m])
            places = np.arange(m) - np.repeat(new - before, runs)
            gaps = docs - np.r_[0, docs[:-1]]
            gaps[new] = docs[new] - last
            blocks = places // size
            starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])])
            keep = m if final else int(starts[-1])
            held, place, doc = rows.slice(keep), int(places[keep]) if keep < m else 0, int(docs[keep] - gaps[keep]) if keep < m else 0
            if not final:
                starts = starts[:-1]
            if not len(starts):
                return None
            ends = np.r_[starts[1:], keep]
            n = ends - starts
            partial = dealt[starts] & (places[starts] % size != 0)
            if final:
                partial[-1] |= bool(dealt[starts[-1]] and n[-1] < size)
            offsets = pa.array(np.r_[starts, keep] - starts[0], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[starts[0] : keep], pa.int64())) for x in (docs, tfs, gaps)]
            sums = [docs[starts], docs[ends - 1], np.maximum.reduceat(tfs[:keep], starts), np.add.reduceat(tfs[:keep], starts), n]
            arrays = [terms.take(pa.array(starts)), pa.array(blocks[starts], pa.int64()), *lists, *[pa.array(x, pa.int64()) for x in sums], pa.array(partial)]
            return pa.RecordBatch.from_arrays(arrays, names=LISTED)

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                done = cut(pa.concat_tables([held, rows]) if held is not None else rows, False)
                if done is not None:
                    yield done
        if held is not None and held.num_rows:
            yield cut(held, True)

    return made


def seal(docs: DataFrame, path: str, fields: tuple[str, ...] = (), key: str = "doc_id", text: str = "text", size: int = BLOCK) -> Sealed:
    """Write the index of docs into a folder of the shared store. Postings are shuffled once, and a term in many documents is dealt over many tasks.

    Null text has no terms; its document is stored. Documents with a null key are left out.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.where(F.col(key).isNotNull())
    counts = shared_table(term_counts(docs, key, text), "counts")
    # terms of more than an eighth of a task's share are cut into buckets of documents; there are eight such terms a task at most
    hot = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > max(SPAN, counts.count() // (8 * n))).select("term", F.lit(True).alias("hot"))
    hot = F.broadcast(shared_table(hot, "hot-terms"))
    ends = docs.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    width = max(SPAN, ((ends.high or 0) - (ends.low or 0)) // 256 + 1)  # 256 buckets of a term at most
    dealt = counts.join(hot, "term", "left").withColumn("bucket", F.when(F.col("hot"), F.floor(F.col("doc_id") / F.lit(width))).otherwise(F.lit(0)).cast("long"))
    order = Window.partitionBy("term").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    pieces = dealt.where("hot").groupBy("term", "bucket").agg(F.count(F.lit(1)).alias("_n"), F.max("doc_id").alias("_last"))
    pieces = pieces.select("term", "bucket", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("before"), F.coalesce(F.max("_last").over(order), F.lit(0)).alias("last"))
    ranged = dealt.select("term", "bucket", "doc_id", "tf").repartitionByRange(n, "term", "bucket").join(F.broadcast(shared_table(pieces, "buckets")), ["term", "bucket"], "left")
    whole = ranged.select("term", "doc_id", "tf", "before", "last").sortWithinPartitions("term", "doc_id")
    schema = "term string, block long, docs array<long>, tfs array<long>, gaps array<long>, first_doc long, last_doc long, max_tf long, cf long, n long, partial boolean"
    whole.mapInArrow(_blocked(size), schema).write.option("parquet.block.size", 8 << 20).option("compression", "zstd").parquet(f"{path}/lists")
    seams = spark.read.parquet(f"{path}/lists").where("partial").groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("first_doc", "docs", "tfs", "gaps"))).alias("x"))  # two a task at most
    seams = seams.select("term", "block", *[F.flatten(f"x.{c}").alias(c) for c in ("docs", "tfs", "gaps")])
    total = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    seams = seams.select("*", F.get("docs", F.lit(0)).alias("first_doc"), F.element_at("docs", -1).alias("last_doc"), F.array_max("tfs").alias("max_tf"), total.alias("cf"), F.size("docs").cast("long").alias("n"))
    seams.coalesce(1).sortWithinPartitions("term", "block").write.parquet(f"{path}/seams")
    found = Sealed(spark, path)
    terms = found.blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"), F.max("max_tf").alias("max_tf"))
    terms.withColumn("singleton", F.col("df") == 1).repartitionByRange(n, "term").sortWithinPartitions("term").write.parquet(f"{path}/dictionary")
    length = F.coalesce(F.regexp_count(F.lower(F.col(text)), F.lit("[a-z0-9]+")), F.lit(0)).cast("long")  # after the sort: finding the ranges reads the rows once more
    stored = docs.select(F.col(key).alias("doc_id"), *dict.fromkeys([*fields, text]))
    row = F.monotonically_increasing_id()  # a task's number and a row's place in it
    stored = stored.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").withColumns({"_row": row, "length": length})
    stored = stored.withColumns({"_range": F.shiftright("_row", 33), "_at": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)), "norm": F.least("length", F.lit(65_535)).cast("int")}).drop("_row")
    stored.select("doc_id", *fields, "length", "norm", "_range", "_at").write.option("compression", "zstd").parquet(f"{path}/stored")
    sizes = spark.read.parquet(f"{path}/stored").groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")).write.parquet(f"{path}/starts")
    return found


def next_at_or_after(posts: DataFrame, found: DataFrame, targets: DataFrame) -> DataFrame:
    """For each (term, target) the first document at or after it, null past the end: the block first, then its postings only."""
    ends = found.select("term", "block", "last_doc").join(targets, "term").where(F.col("last_doc") >= F.col("target"))
    ends = ends.groupBy("term", "target").agg(F.min("block").alias("block"))
    met = posts.select("term", "block", "doc_id").join(ends, ["term", "block"]).where(F.col("doc_id") >= F.col("target"))
    return targets.join(met.groupBy("term", "target").agg(F.min("doc_id").alias("doc_id")), ["term", "target"], "left")


def block_bounds(found: DataFrame, targets: DataFrame) -> DataFrame:
    """For each (term, target) the bounds of the first block that ends at or after it, else of the last block."""
    met = targets.join(found, "term")
    past = F.col("last_doc") >= F.col("target")
    pick = F.coalesce(F.min(F.when(past, F.struct("block", "last_doc", "max_tf"))), F.max(F.struct("block", "last_doc", "max_tf")))
    return met.groupBy("term", "target").agg(pick.alias("b")).select("term", "target", "b.block", "b.last_doc", "b.max_tf")


def live(docs: DataFrame, deletes: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(deletes.select(key), key, "left_anti")


def merge_segments(docs: DataFrame, deletes: DataFrame, segment: str = "segment", key: str = "doc_id") -> DataFrame:
    """Fresh dense ids for live documents, in the order of segments, then of documents."""
    kept = live(docs, deletes, key)
    starts = kept.groupBy(segment).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(segment, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row for each segment
    return numbered(kept, [segment], key, "_local").join(starts, segment).withColumn("new_id", (F.col("_start") + F.col("_local")).cast("long")).drop("_start", "_local")


def merge_candidates(segments: DataFrame, floor: int = 2000, most_docs: int = 50_000_000, fan: int = 10, deletes_percent: int = 33) -> DataFrame:
    """Of (segment, docs, deleted): the first with too many deletes alone, else up to `fan` of the smallest if there are that many."""
    heavy = F.col("deleted") * 100 >= F.col("docs") * deletes_percent
    every = Window.partitionBy(F.lit(0))
    by_size = Window.partitionBy(F.lit(0)).orderBy("floored", "segment")
    sized = segments.withColumn("live", F.col("docs") - F.col("deleted")).withColumn("floored", F.greatest("live", F.lit(floor)))
    sized = sized.withColumns({
        "first_heavy": F.min(F.when(heavy, F.col("segment"))).over(every), "n": F.count(F.lit(1)).over(every),
        "rank": F.row_number().over(by_size), "before": F.coalesce(F.sum("live").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    chosen = F.when(F.col("first_heavy").isNotNull(), F.col("segment") == F.col("first_heavy")).otherwise((F.col("n") >= fan) & (F.col("rank") <= fan) & (F.col("before") < most_docs))
    return sized.withColumn("selected", chosen).select("segment", "docs", "deleted", "selected")


def idf(n_docs: int | Column, df: Column) -> Column:
    n = n_docs if isinstance(n_docs, Column) else F.lit(float(n_docs))
    held = F.greatest(F.least(df.cast("double"), n), F.lit(0.0))
    return F.ln(F.lit(1.0) + (n - held + 0.5) / (held + 0.5))


def saturated(idf_: Column, eff: Column, k1: float = 1.2) -> Column:
    return F.when(eff > 0, idf_ * eff * (k1 + 1) / (k1 + eff)).otherwise(F.lit(0.0))


def top_documents(scored: DataFrame, k: int, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The best k: score descending, then document. Each task keeps k and the driver's stage merges them."""
    return scored.orderBy(F.desc("score"), *by).limit(max(k, 0))


def disjunction(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, score: weights of (term, weight) summed over postings, tf * weight each; a repeated term counts twice."""
    return posts.join(terms, "term").groupBy("doc_id").agg(F.sum(F.col("tf") * F.col("weight")).alias("score"))


@dataclass(frozen=True)
class Bounds:
    """What a search knows before it reads lists: each term's weight and peak, and a floor that no k-th best total is below."""

    weights: dict[str, float]
    peaks: dict[str, float]
    floor: float

    def essential(self) -> list[str]:
        """All terms but the weakest whose peaks together stay below the floor: a document with only those can't be among the best."""
        total, out = 0.0, []
        for term in sorted(self.peaks, key=lambda x: (self.peaks[x], x)):
            total += self.peaks[term]
            if total >= self.floor:
                out.append(term)
        return out


def _by_term(values: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[x for t, v in values.items() for x in (F.lit(t), F.lit(v))]), F.col("term"))


def bounds(found: Sealed, terms: DataFrame, k: int) -> Bounds:
    """Peaks from the dictionary; the floor from the postings of the blocks with the highest bounds, a few hundred for a small k.

    A query's terms come to the driver, with one row of each; weights must not be negative.
    """
    weights = {r.term: r.weight for r in terms.groupBy("term").agg(F.sum("weight").alias("weight")).collect()}
    if min(weights.values(), default=0.0) < 0:
        raise ValueError("pruning needs weights of 0 or more")
    known = {r.term: r.max_tf for r in lookup(found.dictionary, *weights).select("term", "max_tf").collect()}
    peaks = {t: weights[t] * m for t, m in known.items()}
    if not peaks or k <= 0:
        return Bounds(weights, peaks, float("inf") if k <= 0 else float("-inf"))
    weight = _by_term(weights)
    best = lookup(found.blocks, *peaks).withColumn("bound", F.col("max_tf") * weight).orderBy(F.desc("bound"), "term", "block").limit(-(-4 * k // BLOCK) + len(peaks))
    seeds = lookup(found.postings, *peaks).join(F.broadcast(best.select("term", "block")), ["term", "block"])  # as many blocks as the limit says
    sums = seeds.groupBy("doc_id").agg(F.sum(F.col("tf") * weight).alias("part")).orderBy(F.desc("part")).limit(k).agg(F.min("part").alias("floor"), F.count(F.lit(1)).alias("n")).first()
    return Bounds(weights, peaks, sums.floor * (1 - 1e-9) if sums.n == k else float("-inf"))  # sums in another order may differ in the last digits


def _scored(found: Sealed, b: Bounds, docs: DataFrame, k: int) -> DataFrame:
    met = lookup(found.postings, *b.peaks).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return top_documents(met.groupBy("doc_id").agg(F.sum(F.col("tf") * _by_term(b.weights)).alias("score")), k)


def wand(found: Sealed, terms: DataFrame, k: int) -> DataFrame:
    """The same best k as the exhaustive sum. Only lists of essential terms bring candidates; the others are read for those alone."""
    b = bounds(found, terms, k)
    if not b.peaks or k <= 0:
        return disjunction(found.postings.where(F.lit(False)), terms)
    return _scored(found, b, lookup(found.postings, *b.essential()), k)


def block_max(found: Sealed, terms: DataFrame, k: int) -> DataFrame:
    """The same best k again, with candidates only from blocks whose bound, with the other terms' peaks, can reach the floor."""
    b = bounds(found, terms, k)
    if not b.peaks or k <= 0:
        return disjunction(found.postings.where(F.lit(False)), terms)
    lists = b.essential()
    total = sum(b.peaks.values())
    can = F.col("max_tf") * _by_term(b.weights) + F.lit(total) - _by_term(b.peaks) >= F.lit(b.floor)
    useful = lookup(found.blocks, *lists).where(can).select("term", "block")
    return _scored(found, b, lookup(found.postings, *lists).join(useful, ["term", "block"], "left_semi"), k)
