"""SimHash fingerprints and near-duplicate components by pigeonhole blocks.

A fingerprint's bit is 1 if it is set in over half of the hashes of the text's word shingles. Two
fingerprints with at most ``max_bits`` differing bits, cut into ``blocks`` blocks, agree in at least
``blocks - max_bits`` of them; so every close pair meets under one of the keys made of that many
blocks. Rows meeting under a key are verified by Hamming distance, so the result is exact.

Copies fall together first: only distinct fingerprints go through the blocks. A key with very many
of them is cut into chunks and every two chunks meet in a task of their own, of bounded size; a task
returns a spanning forest of what it links, never all its pairs.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and is linked
like any other; a text shorter than a shingle is one shingle; repeated shingles count each time; a
null id takes part without naming its component; equal ids with different texts stay apart unless
their fingerprints link. The input's other columns are kept, clashing names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlmill.llm.common import components, cut, lookup

SHINGLE, SEED, MAX_BITS, BITS = 3, 42, 3, 64
#: Distinct fingerprints of one key that one task compares with each other, and parts in which a key's are counted.
CHUNK, SALTS = 2048, 32


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a whole text, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", to: str = "fp", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``df`` with the fingerprint as a signed long."""

    @F.pandas_udf(T.LongType())
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t, shingle, seed) for t in batch], np.uint64).view(np.int64))

    return df.withColumn(to, prints(F.col(text)))


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Signed masks of all choices of ``blocks - max_bits`` blocks."""
    ends = [BITS * i // blocks for i in range(blocks + 1)]
    own = [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:])]
    return [(m - (1 << BITS)) if (m := sum(c)) >> (BITS - 1) else m for c in combinations(own, blocks - max_bits)]


def _forest(prints: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest over ``prints`` (uint64): each node to its tree's first one."""
    us, vs, left = [], [], np.ones(len(prints), bool)
    for start in range(len(prints)):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo and left.any():
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(prints[rest] ^ prints[todo.pop()]) <= max_bits]
            left[near] = False
            todo.extend(near.tolist())
            us.extend([start] * len(near))
            vs.extend(near.tolist())
    return us, vs


def _linker(max_bits: int):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells come sorted, so each is whole once the next begins; a cell is at most two chunks."""
        kept = None
        for batch in batches:
            now = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            cell = now[["mask", "key", "a", "b"]].to_numpy()
            edge = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1 if len(now) else np.array([], int)
            if not len(edge):
                kept = now
                continue
            yield linked(now["fp"].to_numpy().view(np.uint64)[: edge[-1]], np.r_[0, edge])
            kept = now.iloc[edge[-1] :]
        if kept is not None and len(kept):
            yield linked(kept["fp"].to_numpy().view(np.uint64), np.array([0, len(kept)]))

    def linked(prints: np.ndarray, edges: np.ndarray) -> pd.DataFrame:
        size = np.diff(edges)
        first = edges[:-1][size == 2]
        close = first[np.bitwise_count(prints[first] ^ prints[first + 1]) <= max_bits]
        us, vs = [prints[close]], [prints[close + 1]]
        for a, n in zip(edges[:-1][size > 2], size[size > 2]):
            own = prints[a : a + n]
            u, v = _forest(own, max_bits)
            us.append(own[u])
            vs.append(own[v])
        return pd.DataFrame({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)})

    return link


def links(prints: DataFrame, rows: int, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """Spanning links ``(u, v)`` between distinct fingerprints ``prints(fp)``, of which there are ``rows``.

    The more there are, the longer the keys, so that keys agree by chance about as seldom at any size.
    """
    blocks = blocks_for(rows, max_bits)
    masks = block_masks(blocks, max_bits)
    key = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt")
    keys = prints.select("fp", salt, F.explode(F.array(*key)).alias("k")).select("fp", "salt", "k.mask", "k.key")
    # counted by salt, so that the rows of a hot key are nowhere in one task
    parts = keys.groupBy("mask", "key", "salt").agg(F.count("*").alias("part"))
    met = parts.groupBy("mask", "key").agg(F.sum("part").alias("n")).where("n > 1")
    dealt = parts.join(met, ["mask", "key"]).select("mask", "key", "salt", F.ceil(F.col("n") / chunk).cast("int").alias("c"))
    rows_in = keys.join(dealt, ["mask", "key", "salt"]).withColumn("i", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("c")).cast("int"))
    other = F.explode(F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("c") - 1), F.col("i"))))
    cells = rows_in.withColumn("j", other).select("mask", "key", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "fp")
    sorted_cells = cells.repartition("mask", "key", "a", "b").sortWithinPartitions("mask", "key", "a", "b")
    return sorted_cells.mapInPandas(_linker(max_bits), "u long, v long")


def blocks_for(rows: int, max_bits: int = MAX_BITS) -> int:
    """How many blocks to cut fingerprints into, so that few of ``rows`` agree on a key by chance."""
    return next((b for b in range(max_bits + 2, max_bits + 6) if rows <= 2 ** (BITS * (b - max_bits) // b + 3)), max_bits + 6)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``df``: ``key``, ``text_hash`` (of the whole text), ``fp`` (signed long) and
    ``component_id``, the smallest key that links reach."""
    own = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    prints = cut(with_fingerprint(own, "text", "fp", shingle, seed).select("key", F.xxhash64("text").alias("text_hash"), "fp"))
    classes = cut(prints.groupBy("fp").agg(F.min("key").alias("low"), F.count("*").alias("n")))
    linked = components(links(classes.select("fp"), classes.count(), max_bits))
    roots = classes.join(linked.withColumnRenamed("node", "fp"), "fp")
    lowest = roots.groupBy("root").agg(F.min("low").alias("lowest"), F.count("*").alias("n"))
    joined = lookup(roots.select("fp", "root"), lowest, "root").select("fp", "lowest")
    of_class = cut(classes.join(joined, "fp", "left").select("fp", "n", F.coalesce("lowest", "low").alias("component_id")))
    return lookup(prints, of_class, "fp").select(F.col("key").alias(key), "text_hash", "fp", "component_id")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``df`` with one row of each group of near-duplicates: that of the smallest key.

    Of repeated rows (same key and text) one stays. Rows without a key stay only where nothing links them
    to a row that has one, one for each text. The rows keep their columns.
    """
    return kept_rows(df, near_duplicates(df, key, text, **how), key, text)


def kept_rows(df: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that name their component in ``found`` (key, ``text_hash``, ``component_id``), one of each."""
    keep = cut(found.where(F.col(key).eqNullSafe(F.col("component_id"))).groupBy(F.col(key).alias("__key"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("__n")))
    hashed = df.withColumn("__own", F.xxhash64(F.col(text)))
    of = lambda some: hashed.join(some, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__own") == F.col("__hash")), "left_semi")
    kept = of(keep.where("__n = 1"))
    again = keep.where("__n > 1")
    if not again.isEmpty():
        kept = kept.unionByName(of(again).dropDuplicates([key, "__own"]))
    return kept.drop("__own")
