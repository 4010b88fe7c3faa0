"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced where both agree.

A chunk is encoded by the library with offsets. Its pre-tokens are found from left to right, and where one begins
decides all that follows. So if the text up to a place is rightly parted by the left chunk, and the right chunk
also begins a pre-token there, then what the right chunk has from there on is right too. A place counts on the
left only if another pre-token begins after it and well before the chunk's end, so nothing beyond the chunk could
have changed it. The first such place in the overlap is the splice. Where an overlap has none (one run of letters,
say), the document's chunks are cut again with an overlap four times as wide, until the overlap covers the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, pick
from quarry.llm.encode import encoder, load

#: Characters of a chunk's step and of its overlap with the one before.
STEP, OVERLAP = 32_768, 512
#: Characters before a chunk's end in which its pre-tokens aren't trusted: more than any special token has.
MARGIN = 32
#: How sentencepiece writes a blank.
BLANK = "\u2581"

CHUNK = "doc_id long, n_bytes long, th long, chunk int, chunks int, n_tokens long, head array<struct<at:int,n:long>>, tail array<struct<at:int,n:long>>"


def _chunks(rows: DataFrame, step: int, overlap: int) -> DataFrame:
    """Chunk k is text[k * step : (k + 1) * step + overlap]; the last holds the rest, and is never inside the overlap."""
    length = F.char_length("text")
    n: Column = F.greatest(F.ceil((length - overlap) / F.lit(step)), F.lit(1)).cast("int")
    each = rows.select("doc_id", "n_bytes", "th", "text", n.alias("chunks")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    piece = F.when(F.col("chunks") == 1, F.col("text")).otherwise(F.substring(F.col("text"), F.col("chunk") * step + 1, F.lit(step + overlap)))
    return each.withColumn("piece", piece).drop("text")


def _starts(tokenizer: str, text: str) -> tuple[int, list[tuple[int, int]]]:
    """Tokens of a text, and the places where pre-tokens begin with the tokens before each.

    With sentencepiece a pre-token is a word with the blank before it; that holds where the vocabulary has no piece
    with a blank after another character, which is checked. Without that, no place is proven and overlaps widen.
    """
    found = load(tokenizer)
    if not tokenizer.endswith(".model"):
        made = found.encode(text, add_special_tokens=False)
        words, offsets = made.word_ids, made.offsets
        return len(words), [(offsets[i][0], i) for i in range(len(words)) if i == 0 or words[i] != words[i - 1]]
    pieces = found.encode(text, return_type="proto").pieces
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    place = np.cumsum((raw & 0xC0) != 0x80) - 1  # its offsets are in bytes
    starts = [(int(place[x.begin]), i) for i, x in enumerate(pieces) if i > 0 and x.piece[0] == BLANK and x.piece != BLANK * len(x.piece) and pieces[i - 1].piece[-1] != BLANK]
    return len(pieces), starts if _parts_at_blanks(tokenizer) else []


@lru_cache(maxsize=4)
def _parts_at_blanks(tokenizer: str) -> bool:
    found = load(tokenizer)
    return not any(BLANK in found.id_to_piece(i).lstrip(BLANK) for i in range(found.vocab_size()))


def _encoder(tokenizer: str, step: int, overlap: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("th", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("n_tokens", pa.int64())] + [(x, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int64())]))) for x in ("head", "tail")])

    def edges(text: str, first: bool, last: bool) -> tuple[int, list, list]:
        """Tokens of a chunk; places where pre-tokens begin in its two overlaps, counted from where each begins, and the tokens before."""
        words, starts = _starts(tokenizer, text)
        head = [] if first else [{"at": a, "n": n} for a, n in starts if a < overlap]
        tail = []
        if not last:
            safe = [(a, n) for (a, n), (b, _) in zip(starts, starts[1:], strict=False) if b <= len(text) - MARGIN]
            tail = [{"at": a - step, "n": n} for a, n in safe if a >= step]
        return words, head, tail

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer, counts=True)
        for batch in batches:
            text, chunk, chunks = (batch.column(x).to_pylist() for x in ("piece", "chunk", "chunks"))
            single = [i for i, n in enumerate(chunks) if n == 1]
            got: list = [None] * len(text)
            for i, n in zip(single, count([text[i] for i in single]), strict=True):
                got[i] = (n, [], [])
            for i, n in enumerate(chunks):
                if n > 1:
                    got[i] = edges(text[i], chunk[i] == 0, chunk[i] == n - 1)
            data = [batch.column(x) for x in ("doc_id", "n_bytes", "th", "chunk", "chunks")] + [[x[k] for x in got] for k in range(3)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(data, schema, strict=True)], schema=schema)

    return encode


def _spliced(chunks: DataFrame) -> DataFrame:
    """n_tokens of each chunked document, null where some overlap has no common place.

    Each junction meets the left chunk's tail and the right one's head under its own key; what both counted twice
    is taken off. Rows that repeat a document repeat its chunks alike; times says how often.
    """
    doc = ["doc_id", "th", "n_bytes"]
    left = chunks.where(F.col("chunk") < F.col("chunks") - 1).select(*doc, F.col("chunk").alias("j"), F.col("tail").alias("places"), "n_tokens", F.lit(True).alias("is_left"))
    right = chunks.where(F.col("chunk") > 0).select(*doc, (F.col("chunk") - 1).alias("j"), F.col("head").alias("places"), F.lit(0).cast("long").alias("n_tokens"), F.lit(False).alias("is_left"))
    met = left.unionByName(right).groupBy(*doc, "j").agg(
        F.max(F.when(F.col("is_left"), F.col("places"))).alias("l"), F.max(F.when(~F.col("is_left"), F.col("places"))).alias("r"), F.max("n_tokens").alias("n")
    )
    common = F.array_intersect(F.transform("l", lambda x: x["at"]), F.transform("r", lambda x: x["at"]))
    met = met.withColumn("at", F.array_min(common))
    index = lambda side: F.filter(side, lambda x: x["at"] == F.col("at"))[0]["n"]
    twice = met.select(*doc, F.when(F.col("at").isNotNull(), F.col("n") - index("l") + index("r")).alias("twice"))
    twice = twice.groupBy(*doc).agg(F.sum("twice").alias("twice"), F.max(F.col("twice").isNull()).alias("failed"))
    total = chunks.groupBy(*doc).agg(F.sum("n_tokens").alias("n"), F.sum((F.col("chunk") == 0).cast("long")).alias("times"))
    on = total["doc_id"].eqNullSafe(twice["doc_id"]) & (total["th"] == twice["th"]) & (total["n_bytes"] == twice["n_bytes"])
    joined = total.join(twice, on).select(total["doc_id"], total["th"], total["n_bytes"], "n", "times", "twice", "failed")
    return joined.select(*doc, "times", F.when(~F.col("failed"), (F.col("n") / F.col("times")).cast("long") - F.col("twice")).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens as the library gives them for the whole text, special strings as is its default.

    Null text is empty: no bytes, no tokens. A row for each row, repeats included; other columns are left out.
    Chunks of one huge document go to different tasks where the input's splits allow. Only the bounds of the
    overlaps leave a task, never ids or texts.
    """
    if overlap <= MARGIN:
        raise ValueError(f"an overlap must be wider than {MARGIN} characters")
    rows = pick(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("th"))
    chunks = _chunks(rows, step, overlap).mapInArrow(_encoder(tokenizer, step, overlap), CHUNK)
    chunks = materialize(chunks, "token-chunks")
    out = chunks.where("chunks = 1").select("doc_id", "n_bytes", "n_tokens")
    long = materialize(_spliced(chunks.where("chunks > 1")), "token-spliced")
    while True:
        done = long.where(F.col("n_tokens").isNotNull())
        out = out.unionByName(done.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("col"))
        failed = long.where(F.col("n_tokens").isNull()).select("doc_id", "th", "n_bytes", "times")
        if failed.isEmpty():
            return out
        overlap *= 4
        step = max(step, overlap)
        on = rows["doc_id"].eqNullSafe(failed["doc_id"]) & (rows["th"] == failed["th"]) & (rows["n_bytes"] == failed["n_bytes"])
        again = rows.join(failed, on, "left_semi")
        chunks = materialize(_chunks(again, step, overlap).mapInArrow(_encoder(tokenizer, step, overlap), CHUNK), "token-chunks")
        whole = chunks.where("chunks = 1").select("doc_id", "n_bytes", "n_tokens")
        out = out.unionByName(whole)
        long = materialize(_spliced(chunks.where("chunks > 1")), "token-spliced")
