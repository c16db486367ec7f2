"""Approximate nearest neighbours by a hash-prefix forest.

Every vector gets a long string of hash bits per tree (signs of random projections); a tree is the array
of its strings in order. A query descends each tree to its longest matching prefix, then all trees
ascend together, one bit at a time, until the ranges under the common prefix length hold enough
different candidates. Candidates are scored exactly, in double precision, on the original vectors.

Rows are dealt to shards of bounded size by a hash of their id; each shard has a forest, every query asks
each shard, and a shard returns a query's best ``k`` only. ``candidate_share`` says how much of a shard must
be gathered: vectors without any structure need a large share for a recall of 0.9, clustered ones little.

Inner products of vectors of any length become angles by one more component, which makes all rows equally
long. For the trees and for a first rough ranking, vectors are scaled by powers of two, so that neither
very large nor very small ones leave the range of numbers; scores are those of the vectors as given.

Defined cases: null, empty or zero vectors and such with null or non-finite components take no part;
neither do null ids; vectors of different dimension do not meet; equal scores are ordered by id, and a
score beyond the range of doubles is infinite, or last where it is no number; of a query's own id no
row is a candidate; rows of a repeated id that are equal count once as results; of queries of a repeated
id the best of all results are kept; fewer candidates than ``k`` give fewer rows. ``candidate_share=1``
is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES, BITS, SHARE = 12, 32, 0.55
SHARD_ROWS, QUERY_ROWS, SEED = 8192, 4096, 20240229
#: Products below it lose digits.
TINY = 1e-290


def planes(dim: int, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Directions of all bits, ``(dim, trees * bits)``, orthogonal within groups of ``dim``."""
    rng = np.random.default_rng(seed)
    groups = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-trees * bits // dim))]
    return np.hstack(groups)[:, : trees * bits]


def codes(points: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """``(trees, n)`` hash strings as unsigned integers, first bit highest."""
    signs = (points @ planes(points.shape[1], trees, bits, seed) > 0).reshape(len(points), trees, bits)
    return (signs.astype(np.uint64) << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).T


class Forest:
    """The trees over one shard's points (unit length, already extended)."""

    def __init__(self, points: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.n, self.bits, self.trees, self.seed = len(points), bits, trees, seed
        own = codes(points, trees, bits, seed)
        self.order = np.argsort(own, axis=1, kind="stable")
        self.sorted = np.take_along_axis(own, self.order, axis=1)

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per prefix length, tree and query: where the strings with the query's prefix begin and end."""
        own = codes(queries, self.trees, self.bits, self.seed)
        lo, hi = (np.zeros((self.bits + 1, self.trees, len(queries)), np.int64) for _ in range(2))
        for x in range(self.bits + 1):
            low = own >> np.uint64(self.bits - x) << np.uint64(self.bits - x)
            for t in range(self.trees):
                lo[x, t] = np.searchsorted(self.sorted[t], low[t])
                hi[x, t] = np.searchsorted(self.sorted[t], low[t] + np.uint64((1 << self.bits - x) - 1), side="right")
        return lo, hi

    def candidates(self, queries: np.ndarray, least: int):
        """Per query the places of at least ``least`` different candidates (all points, if fewer)."""
        lo, hi = self.ranges(queries)
        enough = (hi - lo).sum(axis=1) >= least  # falls with the prefix length
        for q in range(len(queries)):
            x = int(np.flatnonzero(enough[:, q]).max(initial=0))
            while True:
                mark = np.zeros(self.n, bool)
                for t in range(self.trees):
                    mark[self.order[t, lo[x, t, q] : hi[x, t, q]]] = True
                if x == 0 or mark.sum() >= least:
                    break
                x -= 1
            yield np.flatnonzero(mark)


def _extended(points: np.ndarray, longest: float) -> np.ndarray:
    scaled = points / longest
    return np.hstack([scaled, np.sqrt(np.maximum(1 - (scaled**2).sum(axis=1), 0))[:, None]])


def _best(ids: np.ndarray, points: np.ndarray, rough: np.ndarray, slack: float, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best places. rough only leaves out what its own error, at most ``slack``, cannot lift into the best."""
    keep = np.flatnonzero(rough >= np.partition(rough, -k)[-k] - slack) if len(rough) > k else np.arange(len(rough))
    with np.errstate(over="ignore", invalid="ignore"):
        score = (points[keep] * query).sum(axis=1)
        if not np.isfinite(score).all() or np.abs(score).min(initial=1.0) < TINY:  # rounding may make ties
            keep = np.arange(len(rough))
            score = (points * query).sum(axis=1)
    top = np.lexsort((ids[keep], -np.where(np.isnan(score), -np.inf, score)))[:k]
    return keep[top], score[top]


def _scaled(x: np.ndarray, exponent: int) -> np.ndarray:
    """``x`` over a power of two, in two steps, as one may be out of range."""
    half = exponent // 2
    return np.ldexp(np.ldexp(x, -half), half - exponent)


def search(
    df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, bits: int = BITS,
    candidate_share: float = SHARE, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: the ``k`` nearest rows of ``df`` that each query finds."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    own = lambda d: d.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    usable = F.coalesce(F.col("id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda v: v != 0), F.lit(False))
    rows, asked = own(df).where(usable), own(queries).where(usable)
    top = F.array_max(F.transform("v", F.abs))
    length = F.log2(top) + F.log2(F.aggregate(F.transform("v", lambda x: x / top), F.lit(0.0), lambda a, x: a + x * x)) / 2
    facts = rows.agg(F.count("*").alias("n"), F.max(length).alias("longest")).first()
    n_queries = asked.count()
    shards, parts = max(1, -(-facts["n"] // shard_rows)), max(1, -(-n_queries // query_rows))
    exponent = int(np.ceil(facts["longest"] or 0.0))
    longest = 2.0 ** ((facts["longest"] or 0.0) - exponent)  # of the scaled rows
    deal = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.select("id", "v", F.size("v").alias("dim"), deal(shards).alias("shard"), each(parts).alias("part"))
    ask = asked.select("id", "v", F.size("v").alias("dim"), each(shards).alias("shard"), deal(parts).alias("part"))

    def find(items: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(items) and len(wanted):
            ids, points = items["id"].to_numpy(), np.stack(items["v"].to_numpy()).astype(float)
            mine, asking = wanted["id"].to_numpy(), np.stack(wanted["v"].to_numpy()).astype(float)
            small = _scaled(points, exponent)
            forest = Forest(_extended(small, longest), trees, bits)
            unit = _scaled(asking.T, np.frexp(np.abs(asking).max(axis=1))[1]).T
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            single, slack = small.astype(np.float32), 4 * asking.shape[1] * np.finfo(np.float32).eps * longest
            turned = np.hstack([unit, np.zeros((len(unit), 1))])
            for q, found in enumerate(forest.candidates(turned, max(k + 1, int(np.ceil(candidate_share * len(points)))))):
                found = found[ids[found] != mine[q]]
                at, score = _best(ids[found], points[found], single[found] @ unit[q].astype(np.float32), slack, asking[q], k)
                out.append(pd.DataFrame({"query_id": mine[q], "vec_id": ids[found[at]], "score": score}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    by = ("dim", "shard", "part")
    got = index.groupBy(*by).cogroup(ask.groupBy(*by)).applyInPandas(find, "query_id long, vec_id long, score double")
    no_number = F.isnan("score")
    nearest = Window.partitionBy("query_id").orderBy(no_number, F.desc("score"), "vec_id")
    return got.distinct().withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
