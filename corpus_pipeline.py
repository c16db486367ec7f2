"""Five stages from raw documents to token ids; each stage's result is written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlmill.llm import bpe, copies, language, mixing, toxicity
from urlmill.llm.common import cut, table
from urlmill.llm.queries import CATEGORIES, category_labels, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: those without a letter, and without text."""
    model = language.fit(docs)
    return language.with_label(docs, model, to="__label").where("__label.lang_pred <> 'und'").drop("__label")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the chain calls toxic."""
    chain = toxicity.fit(docs, category_labels(table(spark, sf_dir, "labels")), CATEGORIES)
    return toxicity.with_scores(docs, chain, to="__scores").where(~toxicity.flag(chain, "toxic", "__scores")).drop("__scores")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: SimHash of five-word shingles, Jaccard similarity 0.8 or more."""
    return copies.keep_first(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents by their rates, so that the domains' tokens approach their targets."""
    rated, _, _ = mixing.with_rates(docs, to="__mix")
    own = [F.col(f"`{c}`") for c in docs.columns]
    return rated.where("__mix.copies > 0").select(*own, F.explode(F.sequence(F.lit(1), F.col("__mix.copies"))).alias("__copy")).drop("__copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests that show the round trip."""
    coded = bpe.with_tokens(docs, bpe.load(tokenizer_path()), ids=True, digests=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language", identify_language), ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("mixing", mix_sources), ("tokens", encode)]

#: The stages learn models and iterate, which SQL does not express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
