"""Byte formats: a gap-coded index export and gzip-member web archives, with readers and writers that Spark runs by partition."""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.index import SPAN
from quarry.operators.ordered import shared_table

MAGIC, VERSION = b"CIFF", 1


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


SMALL = [uvarint(n) for n in range(128)]


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self) -> int:
        out = shift = 0
        while True:
            if self.at >= len(self.data) or shift > 63:
                raise ValueError("the export ends within a number, or has one too long")
            b = self.data[self.at]
            self.at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def text(self) -> str:
        n = self.number()
        if self.at + n > len(self.data):
            raise ValueError("the export ends within a string")
        self.at += n
        return self.data[self.at - n : self.at].decode()


def framed(text: str) -> bytes:
    raw = text.encode()
    return uvarint(len(raw)) + raw


def list_bytes(term: str, posts: list[tuple[int, int]]) -> bytes:
    """A postings list in one piece: gaps from the document before, the first from 0. Documents must ascend."""
    out, before = [framed(term), uvarint(len(posts)), uvarint(sum(tf for _, tf in posts)), uvarint(len(posts))], 0
    for doc, tf in posts:
        if doc < before:
            raise ValueError(f"postings of {term!r} don't ascend")
        out += [uvarint(doc - before), uvarint(tf)]
        before = doc
    return b"".join(out)


def header_bytes(lists: int, docs: int, total: int, mean: float, about: str) -> bytes:
    return MAGIC + b"".join(map(uvarint, (VERSION, lists, docs, total, struct.unpack("<Q", struct.pack("<d", mean))[0]))) + framed(about)


def read_export(data: bytes) -> dict:
    """header fields, lists as (term, df, cf, [(doc, tf)]) and documents as (id, name, length)."""
    if data[:4] != MAGIC:
        raise ValueError("not an index export")
    c = Cursor(data)
    c.at = 4
    if (version := c.number()) != VERSION:
        raise ValueError(f"version {version} isn't known")
    n_lists, n_docs, total = c.number(), c.number(), c.number()
    mean = struct.unpack("<d", struct.pack("<Q", c.number()))[0]
    about, lists, docs = c.text(), [], []
    for _ in range(n_lists):
        term, df, cf, n, doc, posts = c.text(), c.number(), c.number(), c.number(), 0, []
        for _ in range(n):
            doc += c.number()
            posts.append((doc, c.number()))
        lists.append((term, df, cf, posts))
    for _ in range(n_docs):
        docs.append((c.number(), c.text(), c.number()))
    return {"lists": lists, "docs": docs, "total": total, "mean": mean, "about": about}


def export_parts(posts: DataFrame, docs: DataFrame, about: str) -> DataFrame:
    """part, key, place, data: the export in pieces. Joined in the order of the first three, they are the file.

    Part 0 is the header, 1 the lists, 2 the documents. A list is a piece with its term and counts, and after it
    the postings in pieces of one batch each; a term that a third of the documents hold is dealt over many tasks.
    Where a list goes on in the next range of (term, doc_id), the gap begins at the last document of the range before:
    one row for each range comes to the driver for that. docs has doc_id, name, length.
    """
    spark = posts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    totals = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
    schema = "part long, key string, place long, data binary"
    dealt = shared_table(posts.select("term", "doc_id", "tf").repartitionByRange(n, "term", "doc_id").withColumn("range", F.spark_partition_id()), "export")
    terms = shared_table(dealt.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), "export-terms")
    head = header_bytes(terms.count(), totals.docs, totals.total, totals.total / totals.docs if totals.docs else 0.0, about)
    ends = sorted((r.range, r.end) for r in dealt.groupBy("range").agg(F.max(F.struct("term", "doc_id")).alias("end")).collect())
    before_range = {r: end for (r, _), (_, end) in zip(ends[1:], ends, strict=False)}

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [framed(t) + uvarint(df) + uvarint(cf) + uvarint(df) for t, df, cf in zip(batch["term"], batch["df"], batch["cf"], strict=True)]
            yield pd.DataFrame({"part": 1, "key": batch["term"], "place": -1, "data": data})

    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, term, doc, count = None, None, 0, 0
        for batch in batches:
            keys, places, data, at = [], [], [], -1
            for r, t, d, tf in zip(batch["range"], batch["term"], batch["doc_id"], batch["tf"], strict=True):
                if r != held:
                    held, count, at = r, 0, -1
                    term, doc = before_range.get(r, (None, 0))
                if t != term or at < 0:
                    if t != term:
                        term, doc = t, 0
                    at = len(data)
                    keys.append(t)
                    places.append((r << 32) + count)
                    data.append(bytearray())
                    count += 1
                if d < doc:
                    raise ValueError(f"postings of {t!r} don't ascend")
                data[at] += uvarint(d - doc) + uvarint(tf)
                doc = d
            yield pd.DataFrame({"part": 1, "key": keys, "place": places, "data": list(map(bytes, data))})

    # each range goes to one task again, sorted there; files may hold several ranges or a range several files
    ordered = dealt.repartition(n, "range").sortWithinPartitions("range", "term", "doc_id")
    first = spark.createDataFrame([(0, "", 0, bytearray(head))], schema)
    return first.unionByName(terms.mapInPandas(heads, schema)).unionByName(ordered.mapInPandas(bodies, schema)).unionByName(docs.mapInPandas(_record_parts, schema))


def _record_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        data = [uvarint(d) + framed(name) + uvarint(n) for d, name, n in zip(batch["doc_id"], batch["name"], batch["length"], strict=True)]
        yield pd.DataFrame({"part": 2, "key": "", "place": batch["doc_id"], "data": data})


def export_lists(lists: DataFrame, dictionary: DataFrame, docs: DataFrame, about: str) -> DataFrame:
    """What export_parts() gives, joined, of an index's lists: a block is a piece, whose place is its number. Nothing is shuffled."""
    totals = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
    schema = "part long, key string, place long, data binary"
    head = header_bytes(dictionary.count(), totals.docs, totals.total, totals.total / totals.docs if totals.docs else 0.0, about)

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [framed(t) + uvarint(df) + uvarint(cf) + uvarint(df) for t, df, cf in zip(batch["term"], batch["df"], batch["cf"], strict=True)]
            yield pd.DataFrame({"part": 1, "key": batch["term"], "place": -1, "data": data})

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                data = []
                for gaps_, tfs in zip(part.column("gaps").to_pylist(), part.column("tfs").to_pylist(), strict=True):
                    if min(gaps_) < 0:
                        raise ValueError("postings don't ascend")
                    data.append(b"".join(SMALL[x] if x < 128 else uvarint(x) for pair in zip(gaps_, tfs, strict=True) for x in pair))
                yield pa.RecordBatch.from_arrays([pa.array([1] * len(data), pa.int64()), part.column("term"), part.column("block"), pa.array(data, pa.binary())], names=["part", "key", "place", "data"])

    first = lists.sparkSession.createDataFrame([(0, "", 0, bytearray(head))], schema)
    named = dictionary.select("term", "df", "cf").mapInPandas(heads, schema)
    rows = lists.select("term", "block", "gaps", "tfs").mapInArrow(bodies, schema)
    return first.unionByName(named).unionByName(rows).unionByName(docs.mapInPandas(_record_parts, schema))


def decoded(lists: DataFrame) -> DataFrame:
    """term, doc_id, gap of lists' (term, first_doc, gaps): documents are the sums of the gaps, from the document before the block."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = part.column("gaps").flatten()
                gaps_, n = found.to_numpy(), pc.list_value_length(part.column("gaps")).to_numpy()
                starts, totals = np.cumsum(n) - n, np.cumsum(gaps_)
                before = part.column("before").to_numpy() - (totals[starts] - gaps_[starts])
                yield pa.RecordBatch.from_arrays([part.column("term").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(totals + np.repeat(before, n)), found], names=["term", "doc_id", "gap"])

    return lists.select("term", "gaps", (F.col("first_doc") - F.get("gaps", F.lit(0))).alias("before")).mapInArrow(summed, "term string, doc_id long, gap long")


def packed_widths(lists: DataFrame) -> DataFrame:
    """term, block, width, cost: bits for each tf of a block with six bytes for each that needs more, at the least cost; of equal costs the smaller width."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                tfs, n = part.column("tfs").flatten().to_numpy(), pc.list_value_length(part.column("tfs")).to_numpy().astype(np.int64)
                starts = np.cumsum(n) - n
                costs = [(n * w + 7) // 8 + 6 * np.add.reduceat((tfs >= 1 << w).astype(np.int64), starts) for w in range(1, 33)]
                best = np.argmin(costs, axis=0)  # the first of equals
                yield pa.RecordBatch.from_arrays([part.column("term"), part.column("block"), pa.array(best + 1, pa.int64()), pa.array(np.min(costs, axis=0), pa.int64())], names=["term", "block", "width", "cost"])

    return lists.select("term", "block", "tfs").mapInArrow(chosen, "term string, block long, width long, cost long")


def gaps(posts: DataFrame) -> DataFrame:
    """term, doc_id, gap: what the export stores for each posting. Lists are worked off in spans of documents; the last of the span before is looked up."""
    spans = posts.select("term", "doc_id", F.floor(F.col("doc_id") / F.lit(SPAN)).alias("_span"))
    last = spans.groupBy("term", "_span").agg(F.max("doc_id").alias("_last"))
    last = last.select("term", "_span", F.lag("_last").over(Window.partitionBy("term").orderBy("_span")).alias("_before"))
    inside = F.lag("doc_id").over(Window.partitionBy("term", "_span").orderBy("doc_id"))
    found = spans.withColumn("_inside", inside).join(last, ["term", "_span"])
    return found.select("term", "doc_id", (F.col("doc_id") - F.coalesce("_inside", "_before", F.lit(0))).alias("gap"))


# --- web archives


def base32_sha1(block: bytes) -> str:
    return base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_bytes(kind: str, date: str, record_id: str, uri: str, content_type: str, fields: dict[str, str], block: bytes) -> bytes:
    """One record, uncompressed, in the fixed order of headers."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date}", f"WARC-Record-ID: <urn:uuid:{record_id}>"]
    if uri:
        lines.append(f"WARC-Target-URI: {uri}")
    if block:
        lines.append(f"WARC-Block-Digest: sha1:{base32_sha1(block)}")
    lines.append(f"Content-Type: {content_type or 'application/octet-stream'}")
    lines += [f"{k}: {fields[k]}" for k in sorted(fields)]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def archive_members(records: DataFrame, stem: str = "quarry") -> DataFrame:
    """seq, member: each record (seq, kind, date, uri, content_type, fields, block) as a gzip member of its own."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            members = [
                gzip.compress(record_bytes(r.kind, r.date, f"{stem}-{r.seq:012d}", r.uri or "", r.content_type or "", dict(r.fields or {}), bytes(r.block or b"")), mtime=0) for r in batch.itertuples()
            ]
            yield pd.DataFrame({"seq": batch["seq"], "member": members})

    return records.mapInPandas(pack, "seq long, member binary")


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def metadata_block(fields: Column) -> Column:
    """Sorted key: value lines, each with a carriage return and a line feed."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\r\n"))), "")
