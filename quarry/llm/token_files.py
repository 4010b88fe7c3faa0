"""Token ids in a bit-plane file format, written in document order and read back.

A file holds the ids of some documents in a row, cut into blocks of BLOCK ids. A block is transposed into planes:
one for each byte of an id (PLANES = "byte") or for each bit ("bit"), as many as its largest id needs, each packed
and compressed with zstandard on its own. Equal high bytes and rare bits then compress to almost nothing.

    magic "QTOK1\\n", plane kind (0 byte, 1 bit)
    blocks: the planes of each, least significant first
    index: for each block its offset, ids, planes and the planes' compressed sizes; then each document's length
    footer: offset of the index, blocks, documents, crc32 of the index; magic again

Files go to a folder that all executors share, by the path's own file system; each is written under a name of
its task's attempt and renamed when whole, so a task that runs again leaves one file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import new_path, pick
from quarry.llm.encode import encoder

MAGIC, BLOCK = b"QTOK1\n", 1 << 16
FOOTER = struct.Struct("<QIQI6s")


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of a block of unsigned 32-bit ids, least significant first."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if bits:
        return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(top)]
    return [(ids >> np.uint32(8 * k)).astype(np.uint8).tobytes() for k in range((top + 7) // 8)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    out = np.zeros(n, dtype="<u4")
    for k, plane in enumerate(planes):
        got = np.frombuffer(plane, dtype=np.uint8)
        out |= (np.unpackbits(got, count=n) if bits else got).astype("<u4") << np.uint32(k if bits else 8 * k)
    return out


class Writer:
    """One file: add() documents in order, then close()."""

    def __init__(self, out, bits: bool = False, block: int = BLOCK, level: int = 3):
        self.out, self.bits, self.block = out, bits, block
        self.press = zstandard.ZstdCompressor(level=level)
        self.index, self.lengths, self.waiting, self.held = [], [], [], 0
        self.at = 0
        self._put(MAGIC + bytes([bits]))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, raw: bytes) -> None:
        """A document's ids as little-endian unsigned 32-bit bytes."""
        self.lengths.append(len(raw) // 4)
        self.waiting.append(raw)
        self.held += len(raw) // 4
        if self.held >= self.block:
            self._blocks(whole=False)

    def _blocks(self, whole: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), dtype="<u4")
        end = len(ids) if whole else len(ids) // self.block * self.block
        for at in range(0, end, self.block):
            part = ids[at : min(at + self.block, end)]
            planes = [self.press.compress(x) for x in to_planes(part, self.bits)]
            self.index.append((self.at, len(part), [len(x) for x in planes]))
            self._put(b"".join(planes))
        self.waiting = [ids[end:].tobytes()] if end < len(ids) else []
        self.held = len(ids) - end

    def close(self) -> None:
        self._blocks(whole=True)
        index = b"".join(struct.pack(f"<QIB{len(s)}I", at, n, len(s), *s) for at, n, s in self.index)
        index = zstandard.compress(index + np.asarray(self.lengths, dtype="<u8").tobytes())
        self._put(index)
        self.out.write(FOOTER.pack(self.at - len(index), len(self.index), len(self.lengths), zlib.crc32(index), MAGIC))


class Reader:
    """A seekable file: the documents' lengths, and the ids of any block or range."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        if size < FOOTER.size + len(MAGIC) + 1:
            raise ValueError("not a token file: too short")
        file.seek(0)
        head = file.read(len(MAGIC) + 1)
        file.seek(size - FOOTER.size)
        at, blocks, docs, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        if head[:-1] != MAGIC or magic != MAGIC:
            raise ValueError("not a token file: wrong magic")
        file.seek(at)
        index = file.read(size - FOOTER.size - at)
        if zlib.crc32(index) != crc:
            raise ValueError("the index of the token file is damaged")
        self.bits, index, self.blocks, p = bool(head[-1]), zstandard.decompress(index), [], 0
        for _ in range(blocks):
            offset, n, planes = struct.unpack_from("<QIB", index, p)
            self.blocks.append((offset, n, struct.unpack_from(f"<{planes}I", index, p + 13)))
            p += 13 + 4 * planes
        self.lengths = np.frombuffer(index, dtype="<u8", offset=p)
        if len(self.lengths) != docs:
            raise ValueError("the index of the token file is damaged")

    def block(self, k: int) -> np.ndarray:
        offset, n, sizes = self.blocks[k]
        self.file.seek(offset)
        data, planes, at = self.file.read(sum(sizes)), [], 0
        press = zstandard.ZstdDecompressor()
        for size in sizes:
            planes.append(press.decompress(data[at : at + size]))
            at += size
        return from_planes(planes, n, self.bits)

    def documents(self) -> Iterator[np.ndarray]:
        """Ids of each document in turn, a block at a time."""
        have, k = np.zeros(0, dtype="<u4"), 0
        for length in self.lengths.tolist():
            parts, need = [], length
            while need > len(have):
                parts.append(have)
                need -= len(have)
                have, k = self.block(k), k + 1
            parts.append(have[:need])
            have = have[need:]
            yield np.concatenate(parts) if len(parts) > 1 else parts[0]


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int, bits: bool = False, key: str = "doc_id", text: str = "text") -> list[dict]:
    """Encode whole texts in ascending doc_id order into files under path; a manifest row for each file, in order.

    Documents are dealt by range over doc_id and sorted there, so files follow one another; rows that repeat a
    doc_id split too. Null text is empty; a null doc_id comes first. The manifest has a row for each task.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pick(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"_th": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(n, "doc_id", "_th", "_row").sortWithinPartitions("doc_id", "_th", "text")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, ids, part, total, name = encoder(tokenizer), None, [], None, 0, ""
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                part = batch.column("part")[0].as_py()
                name = f"{folder}/.{part}-{uuid.uuid4().hex}"
                store.create_dir(folder, recursive=True)
                file = store.open_output_stream(name)
                out = Writer(file, bits)
            for at in range(0, batch.num_rows, 256):
                for raw in encode(batch.column("text").slice(at, 256).to_pylist()):
                    out.add(raw + end)
                    total += len(raw) // 4 + 1
            ids += batch.column("doc_id").to_pylist()
        if out is not None:
            keys = np.asarray([(x is None, x or 0) for x in ids], dtype="<i8")
            out.close()
            file.close()
            side = store.open_output_stream(name + "-ids")
            side.write(zstandard.compress(keys.tobytes()))
            side.close()
            store.move(name + "-ids", f"{folder}/{part:08d}.ids")
            store.move(name, f"{folder}/{part:08d}.tok")
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(ids)], "tokens": [total]}, schema=pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    manifest = rows.mapInArrow(write, "part int, docs long, tokens long").toPandas().sort_values("part")
    starts = manifest.tokens.cumsum() - manifest.tokens
    return [{"file": f"{path}/{p:08d}", "docs": d, "tokens": t, "start": s} for p, d, t, s in zip(manifest.part.tolist(), manifest.docs.tolist(), manifest.tokens.tolist(), starts.tolist(), strict=True)]


def read_token_files(spark, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files; a file is a task's work."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, start in zip(batch.file, batch.start, strict=True):
                store, place = fs.FileSystem.from_uri(name)
                with store.open_input_file(place + ".ids") as side:
                    keys = np.frombuffer(zstandard.decompress(side.read()), dtype="<i8").reshape(-1, 2)
                with store.open_input_file(place + ".tok") as file:
                    reader = Reader(file)
                    lengths = reader.lengths.astype("i8")
                    crcs = [zlib.crc32(x) for x in reader.documents()]
                ids = pd.array(keys[:, 1], dtype="Int64")
                ids[keys[:, 0] == 1] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "start": start + np.cumsum(lengths) - lengths, "n_tokens": lengths, "ids_crc32": crcs})

    files = spark.createDataFrame([(x["file"], x["start"]) for x in manifest], "file string, start long")
    return files.repartition(len(manifest)).mapInPandas(read, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int, bits: bool = False, path: str | None = None) -> DataFrame:
    """Write documents as token files and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    if path.startswith("/"):
        path = "file://" + os.path.abspath(path)
    return read_token_files(spark, write_token_files(docs, tokenizer, path, end_id, bits))
