"""Shards by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws ln(u)/weight, with u in (0, 1) from the
key and the child's path, and the largest draw wins, so children receive keys in proportion to their weights. A
child's draw depends on nothing but the key, its path and its weight: when weights change, keys move only into
subtrees that grew or out of those that shrank. A subtree's weight is the sum of its shards' weights.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import pick, slots_in_order

HEX = 13  # 52 bits of a digest for each draw


@dataclass(frozen=True)
class Tree:
    """regions[r][k] is a rack: its (shard, weight) pairs. Weights are positive."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def build(shards: int, racks: int = 4, per_rack: int = 2) -> Tree:
        """Shards 0 and up, of weight 1, filling racks of per_rack and regions of racks in turn."""
        if shards < 1:
            raise ValueError("a tree needs a shard")
        each = [((i, 1.0) for i in range(at, min(at + per_rack, shards))) for at in range(0, shards, per_rack)]
        each = [tuple(x) for x in each]
        return Tree(tuple(tuple(each[at : at + racks]) for at in range(0, len(each), racks)))

    def expanded(self, weight: float = 1.0) -> Tree:
        """One more shard, as a region of its own: no older subtree's weight changes, so keys move only into it."""
        return Tree((*self.regions, (((self.count(), weight),),)))

    def reweighted(self, shard: int, weight: float) -> Tree:
        return Tree(tuple(tuple(tuple((s, weight if s == shard else w) for s, w in rack) for rack in region) for region in self.regions))

    def count(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def draw(key: Column, path: str, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{path}"))), 1, HEX), 16, 10).cast("double")
    return F.log((bits + F.lit(0.5)) / F.lit(float(16**HEX))) / F.lit(float(weight))


def choose(key: Column, tree: Tree) -> Column:
    """The shard of a key (a string column). Equal draws go to the child named first."""

    def best(children: list[tuple[str, float, Column]]) -> Column:
        if len(children) == 1:
            return children[0][2]
        draws = F.array(*[draw(key, path, weight) for path, weight, _ in children])
        place = F.transform(F.array(draws), lambda x: F.array_position(x, F.array_max(x)))[0]
        picked = F.transform(F.array(place), lambda p: _case([(p == i + 1, child) for i, (_, _, child) in enumerate(children)]))
        return picked[0]

    regions = []
    for r, region in enumerate(tree.regions):
        racks = []
        for k, rack in enumerate(region):
            shards = [(f"{r}/{k}/{s}", w, F.lit(s)) for s, w in rack]
            racks.append((f"{r}/{k}", sum(w for _, w in rack), best(shards)))
        regions.append((f"{r}", sum(x[1] for x in racks), best(racks)))
    return best(regions)


def _case(pairs: list[tuple[Column, Column]]) -> Column:
    out = F.when(*pairs[0])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out


def assign_shards(docs: DataFrame, tree: Tree, grown: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard (null without a grown tree), slot (gapless from 0 in each shard, by doc_id).

    Law `key`: the key and the tree decide. size is the text's UTF-8 bytes plus 8; a null text counts none and
    has the checksum 0, as an empty one. A null key is a key of its own. Rows that repeat a key share its shard
    and get slots of their own. Other columns are left out. An empty table gives an empty one.
    """
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    body = F.coalesce(F.col("text"), F.lit(""))
    placed = pick(docs, doc_id=key, text=text).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        choose(named, tree).cast("int").alias("shard"),
        (choose(named, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    return slots_in_order(placed, "shard", ["doc_id", "text_crc32", "size"], "slot", "shards")


def write_shards(docs: DataFrame, tree: Tree, path: str, key: str = "doc_id") -> None:
    """The rows themselves, a folder for each shard. Tasks write what they hold; no shard passes through one task."""
    named = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    docs.withColumn("_shard", choose(named, tree)).write.partitionBy("_shard").parquet(path)
