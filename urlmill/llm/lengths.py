"""Token counts: one exact histogram of encoded lengths answers every context limit.

Documents are counted by length; suffix sums over the lengths then give, for every limit, the documents
over it, the tokens a cut at the limit leaves, and quantiles. The sums run in two levels (blocks of
lengths, then lengths within a block), so no task holds all lengths.

Defined cases: null and empty texts have length 0; an empty table gives no row; equal lengths share a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlmill.llm.common import cut

#: Lengths of one block: one task sorts a block's lengths, and one task the blocks.
BLOCK = 128


def histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """Rows ``(n_tokens, docs)`` of a table of lengths."""
    return lengths.groupBy(F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n_tokens")).agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per length L: ``docs``; ``docs_from`` and ``tokens_from`` (documents of length L or more, and their
    tokens); ``docs_to`` and ``tokens_to`` (length L or less); ``truncated_total``, the sum of
    min(length, L); ``total_docs`` and ``total_tokens``; ``share_to`` = docs_to / total_docs."""
    hist = cut(hist)  # read twice below; without a cut the texts would be encoded for each reading
    own = hist.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    by_block = own.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row per block of lengths
    total = Window.partitionBy()
    blocks = by_block.select(
        "block", F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("ld"), F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("lt"),
        F.sum("bd").over(total).alias("total_docs"), F.sum("bt").over(total).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    sums = own.join(blocks, "block").withColumn("docs_from", F.sum("docs").over(within) + F.col("ld"))
    sums = sums.withColumn("tokens_from", F.sum("tokens").over(within) + F.col("lt"))
    docs_to, tokens_to = F.col("total_docs") - F.col("docs_from") + F.col("docs"), F.col("total_tokens") - F.col("tokens_from") + F.col("tokens")
    return sums.select(
        "n_tokens", "docs", "docs_from", "tokens_from", docs_to.alias("docs_to"), tokens_to.alias("tokens_to"),
        (F.col("total_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
        "total_docs", "total_tokens", (docs_to / F.col("total_docs")).alias("share_to"),
    )


def answers(sums: DataFrame, limits: DataFrame, limit: str = "context") -> DataFrame:
    """Per row of ``limits``: documents and tokens over the limit, tokens left by a cut at it.

    Between two lengths every sum follows from the next larger length, so the lookup is one ordered
    merge of limits and lengths, not a product. One task merges them: there are as many rows as different
    lengths and limits, whatever the number of documents. A null limit gives no row.
    """
    ask = limits.where(F.col(limit).isNotNull()).select(F.col(limit).cast("long").alias("n_tokens")).distinct()
    none = F.lit(None).cast("long")
    own = sums.select("n_tokens", "docs_from", "tokens_from", F.lit(False).alias("asked"))
    marked = own.unionByName(ask.select("n_tokens", none.alias("docs_from"), none.alias("tokens_from"), F.lit(True).alias("asked")))
    up = Window.orderBy(F.desc("n_tokens"), F.asc("asked")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = marked.select("n_tokens", "asked", *[F.coalesce(F.last(c, ignorenulls=True).over(up), F.lit(0)).alias(c) for c in ("docs_from", "tokens_from")]).where("asked")
    total = sums.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total_tokens"))
    beyond = F.col("tokens_from") - F.col("n_tokens") * F.col("docs_from")
    return found.join(F.broadcast(total)).select(
        F.col("n_tokens").alias(limit), F.col("docs_from").alias("docs_at_least"), beyond.alias("tokens_cut"), (F.col("total_tokens") - beyond).alias("truncated_total")
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share ``q`` of the documents does not exceed."""
    return sums.where(F.col("docs_to") >= F.lit(q) * F.col("total_docs")).agg(F.min("n_tokens").alias("n_tokens"))
