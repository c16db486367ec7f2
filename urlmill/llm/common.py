"""Helpers that several operators share: durable cut points, seeded sampling, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as ``spark.checkpoint.dir`` names it.

    There is no other choice in its place: a folder of one machine would be lost with that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in at most ``parts`` files, and go on from the written copy."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return (df if parts is None else df.coalesce(parts)).checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a table of columns, for copies of which later steps read few columns."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Carried:
    """Pickles as its content with the code of that content's classes, and is read back as the content."""

    def __init__(self, content: object):
        self.content = content

    def __reduce__(self) -> tuple:
        return cloudpickle.loads, (cloudpickle.dumps(self.content),)


def share(spark: SparkSession, content: object) -> Broadcast:
    """A broadcast whose ``value`` is ``content`` on executors, which need not have this package.

    A worker keeps the value between the tasks of a stage, so caches in it stay warm.
    """
    return spark.sparkContext.broadcast(_Carried(content))


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` different rows of ``df``, those with the smallest hashes: the same on every run.

    Repeated rows count once. Of large tables only the lowest hashes are compared, 16 times as many rows
    as wanted, so that nothing of the table's size is shuffled; more only if too many of them are repeated.
    """
    by = F.xxhash64(*[F.col(c) for c in df.columns])
    share = 16 * rows / max(df.count(), 1)
    while True:
        low = df if share >= 1 else df.where(by < F.lit(-(2**63) + int(2**64 * share)))
        found = cut(low.distinct().orderBy(by, *df.columns).limit(rows))
        if share >= 1 or found.count() == rows:
            return found
        share *= 16


def labelled_texts(docs: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """At most ``rows`` rows ``(label, text)`` of documents with a label; of equal keys and labels one row counts."""
    known = docs.where(F.col(label).isNotNull())
    chosen = bounded_sample(known.select(F.col(key).cast("string").alias("__key"), F.col(label).cast("string").alias("label")), rows)
    # at most ``rows`` slim rows, so the sample may be broadcast
    own = known.select(F.col(key).cast("string").alias("__own"), F.col(label).cast("string").alias("__label"), F.col(text).alias("text"))
    met = own.join(F.broadcast(chosen), F.col("__own").eqNullSafe(F.col("__key")) & (F.col("__label") == F.col("label")))
    return met.groupBy("__key", "label").agg(F.min("text").alias("text")).select("label", "text")


def lookup(rows: DataFrame, values: DataFrame, on: str, count: str = "n") -> DataFrame:
    """``rows`` with the columns of ``values``, whose rows have different ``on`` and say how many ``rows`` they meet.

    A value that meets over a thousandth of all rows is broadcast (there are under 1,000 such values); its
    rows are then dealt out at random places of the shuffle, so no task gets all rows of a key. Rows
    that meet nothing get nulls; a null ``on`` meets nothing.
    """
    names = [c for c in values.columns if c not in (on, count)]
    total = values.agg(F.sum(count)).first()[0] or 0
    hot = values.where(F.col(count) > total / 1000).select(F.col(on).alias("__hot"), F.struct(*names).alias("__have"))
    marked = rows.join(F.broadcast(hot), F.col(on) == F.col("__hot"), "left")
    spread = F.when(F.col("__hot").isNotNull() | F.col(on).isNull(), F.xxhash64(*[c for c in rows.columns if c != on])).otherwise(F.lit(0))
    own = values.where(F.col(count) <= total / 1000).select(F.col(on).alias("__on"), F.lit(0).cast("long").alias("__zero"), F.struct(*names).alias("__own"))
    met = marked.withColumn("__spread", spread).join(own, (F.col(on) == F.col("__on")) & (F.col("__spread") == F.col("__zero")), "left")
    return met.select(*rows.columns, *[F.coalesce(F.col(f"__have.{c}"), F.col(f"__own.{c}")).alias(c) for c in names])


def unit_hash(*parts: Column) -> Column:
    """A double in (0, 1) from the first 52 bits of an MD5: the same number in any engine that has MD5."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def frames(rows, columns: list[str], most: int = 20_000) -> Iterator[pd.DataFrame]:
    """Row tuples as data frames of bounded size, whatever their number."""
    rows = iter(rows)
    while part := list(islice(rows, most)):
        yield pd.DataFrame({c: pd.Series(v, dtype=object if isinstance(v[0], str) else None) for c, v in zip(columns, zip(*part))})


def components(edges: DataFrame, rounds: int = 60, parts: int | None = None) -> DataFrame:
    """Connected components of ``edges(u long, v long)``: rows ``(node, root)``, root the smallest node.

    Alternating large-star and small-star rewrites: each hangs a node's neighbours on the smallest of
    them, so the depth shrinks geometrically while the number of edges never grows. A node's
    neighbours are only ever reduced to their minimum, never gathered; where one node has very many, its
    join is a sort-merge join that adaptive execution splits. Every round is cut to the shared folder, in at
    most ``parts`` files. Nodes without an edge do not appear.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), parts)
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = cut(small.where("u <> v").distinct(), parts)
        # Stars are reached once no node hangs on two, and no root hangs on another node.
        alone = after.groupBy("u").count()
        if alone.where("count > 1").isEmpty() and after.select(F.col("v").alias("u")).join(alone, "u", "left_semi").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now = after
    raise RuntimeError(f"no fixed point after {rounds} rounds")
