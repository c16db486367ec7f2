"""Sharding by a hierarchical weighted hash tree.

Regions hold racks, racks hold shards, shards have weights. A row descends level by level: every child
of the node it stands on draws ``-ln(u) / weight`` with ``u`` hashed from the row's key, the node and the
child, and the smallest draw wins. A child's draws depend on nothing but itself, so when a weight changes,
rows move only into or out of the subtree whose weight changed.

``grow`` hangs each further shard into a region of its own. Then no weight that existed before changes, and
all rows that move go to the new shard: the law ``key``.

Defined cases: a null text has 8 bytes of size and the CRC of no bytes, 0; a null key is placed like the
empty string; repeated rows get slots of their own (rows equal in key and text are numbered in one task).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlmill.llm.common import stored, unit_hash

REGIONS, RACKS, SHARDS = 3, 2, 4
#: Rows that one sorted piece of a shard should hold, for numbering.
PIECE_ROWS = 50_000


@dataclass(frozen=True)
class Tree:
    """``regions[r][k][s]``: the weight of shard s in rack k of region r. Shards are numbered in this order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @property
    def count(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grow(self, weight: float = 1.0) -> Tree:
        return Tree((*self.regions, ((weight,),)))


def balanced(regions: int = REGIONS, racks: int = RACKS, shards: int = SHARDS) -> Tree:
    return Tree((((1.0,) * shards,) * racks,) * regions)


def _winner(key: Column, level: str, weights: list[float]) -> Column:
    """The child with the smallest draw; children without weight draw nothing."""
    draws = [F.struct((-F.log(unit_hash(key, F.lit(f"{level}/{i}"))) / F.lit(float(w))).alias("draw"), F.lit(i).alias("child")) for i, w in enumerate(weights) if w > 0]
    return F.least(*draws)["child"] if len(draws) > 1 else draws[0]["child"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard number of a key."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    region = _winner(key, "", [sum(map(sum, r)) for r in tree.regions])
    at, by_region = 0, []
    for r, racks in enumerate(tree.regions):
        by_rack = []
        for k, shards in enumerate(racks):
            by_rack.append(_winner(key, f"{r}/{k}", list(shards)) + F.lit(at))
            at += len(shards)
        rack = _winner(key, f"{r}", [sum(s) for s in racks])
        by_region.append(_pick(rack, by_rack))
    return _pick(region, by_region).cast("int")


def _pick(which: Column, of: list[Column]) -> Column:
    """``of[which]``; only the chosen branch is evaluated."""
    if len(of) == 1:
        return of[0]
    out = F.when(which == 0, of[0])
    for i, c in enumerate(of[1:-1], 1):
        out = out.when(which == i, c)
    return out.otherwise(of[-1])


def assign(df: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``key, size, text_crc32, law, shard, slot, grown_shard``.

    Slots number a shard's rows from 0 without gaps, by pieces: each shard's rows are dealt to pieces by
    a hash of key and text, pieces are counted, and a row's slot is its place in its piece plus the rows of
    the pieces before. No task sorts a whole shard. The texts are read once; what is counted and numbered
    is the written narrow table.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    pieces = max(4, -(-df.count() // (PIECE_ROWS * tree.count)))
    body = F.col(text)
    slim = stored(
        df.select(
            F.col(key), (F.coalesce(F.octet_length(body), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            shard_of(F.col(key), tree).alias("shard"), shard_of(F.col(key), tree.grow()).alias("grown_shard"),
        )
    )
    dealt = slim.withColumn("piece", F.pmod(F.xxhash64(name, "text_crc32"), F.lit(pieces)))
    counts = dealt.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = Window.partitionBy("shard", "piece").orderBy(key, "text_crc32", "size")
    placed = dealt.withColumn("place", F.row_number().over(place) - 1).join(starts, ["shard", "piece"])
    slot = (F.col("start") + F.col("place")).cast("long").alias("slot")
    return placed.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")
