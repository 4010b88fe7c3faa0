"""Comparing the rows of a bucket in bounded blocks, whatever the buckets' sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.encode import forget

#: Rows of a block. A bucket of more rows is cut into blocks, and every two blocks meet in a group of their own.
BLOCK = 2048
#: Groups of so many rows at most are compared many at a time.
SMALL = 16


def meet(rows: DataFrame, key: str, compare: Callable[[pa.Table, np.ndarray | None], dict | None], schema: str, block: int = BLOCK, weight: str | None = None, most: int = 0, small: int = SMALL) -> DataFrame:
    """Run compare on the rows of each bucket, or on each two blocks of a large one, and collect what it returns.

    rows has `key` (long) and `gid` (long), beside what compare wants. compare gets an Arrow table and either None, if the
    table is one group, or the group of each of its rows, if it holds several of `small` rows at most. The table has
    "_side": rows of side 0 are to be compared with all, of side 1 with side 0 only (two different blocks: one
    side each; one block or a whole bucket: all rows are of both, and _side is 2). It never sees more than two
    blocks, so a bucket that holds a third of all rows is a set of small tasks; pairs themselves aren't emitted.
    With weight (a long column), blocks hold about `most` of it at most too, as rows are dealt to them by a hash; there
    are never more blocks than rows, so a few huge rows aren't copied more often than they are many.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), (F.sum(weight) if weight else F.lit(0)).alias("_weight"))
    blocks = F.least(F.ceil(F.greatest(F.col("_n") / F.lit(block), F.col("_weight") / F.lit(most or 1))), F.col("_n")).cast("int")
    hot = counts.where((F.col("_n") > block) | (F.col("_weight") > most)).select(F.col(key).alias("_hot"), blocks.alias("_blocks"))
    dealt = rows.join(hot, rows[key] == hot["_hot"], "left").drop("_hot")
    own = F.when(F.col("_blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("gid"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_own", own)
    others = F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = dealt.withColumn("_other", F.explode(others)).drop("_blocks")
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    dealt = dealt.withColumn("_group", F.xxhash64(key, low, high)).withColumn("_side", F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") == low, 0).otherwise(1))
    dealt = dealt.withColumn("_k", F.col(key)).drop("_other", "_own", key)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "_group").sortWithinPartitions("_group", "_k")
    return dealt.mapInArrow(lambda batches: _groups(batches, compare, schema, small), schema)


def _groups(batches: Iterator[pa.RecordBatch], compare: Callable, schema: str, small: int) -> Iterator[pa.RecordBatch]:
    forget()
    held: pa.Table | None = None
    target = SCHEMAS[schema]

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        keys = np.stack([table.column("_group").to_numpy(), table.column("_k").to_numpy()])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [table.num_rows]])
        sizes = ends - begins
        few = (sizes > 1) & (sizes <= small)
        if few.any():
            rows = np.repeat(few, sizes)
            got = compare(table.filter(pa.array(rows)), np.repeat(np.flatnonzero(few), sizes[few]))
            if got:
                yield pa.RecordBatch.from_pydict(got, schema=target)
        for k in np.flatnonzero((sizes > 1) & ~few).tolist():
            got = compare(table.slice(begins[k], sizes[k]), None)
            if got:
                yield pa.RecordBatch.from_pydict(got, schema=target)

    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, part]).combine_chunks() if held is not None else part
        last = (table.column("_group")[-1].as_py(), table.column("_k")[-1].as_py())
        same = (table.column("_group").to_numpy() == last[0]) & (table.column("_k").to_numpy() == last[1])
        cut = int(np.argmax(same))
        held = table.slice(cut)
        yield from run(table.slice(0, cut))
    if held is not None:
        yield from run(held)


def pairs_of(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of rows of one group, i before j; rows of a group are neighbours."""
    for lag in range(1, len(group)):
        i = np.flatnonzero(group[lag:] == group[:-lag])
        if not len(i):
            return
        yield i, i + lag


SCHEMAS: dict[str, pa.Schema] = {
    "a long, b long": pa.schema([("a", pa.int64()), ("b", pa.int64())]),
    "a long, b long, n long": pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]),
}


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For n rows and links between places left[i] and right[i], each row's root: the least place reachable."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return root


def grown(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The roots (as forest gives them) with these links too. Links come in parts, so that a dense block's pairs are never held at once."""
    new = root[left] != root[right]
    return forest(root[left[new]], root[right[new]], len(root))[root] if new.any() else root
