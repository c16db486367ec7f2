"""The queries of the ten operators, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlmill.llm import bpe, forest, language, lengths, licenses, matroska, mixing, sharding, simhash, toxicity
from urlmill.llm.common import table

CATEGORIES = ("low_quality", "toxic")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file is."""
    return public_tokenizers.path(name)


def category_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, category_labels(table(spark, sf_dir, "labels")), CATEGORIES)
    return toxicity.predict(docs, chain).select("doc_id", "p_low_quality", "p_toxic", "is_low_quality", "is_toxic")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.balanced())


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    return language.predict(docs, model).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"), "spans")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated, weights, facts = mixing.mix(table(spark, sf_dir, "documents"))
    posterior = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(weights.domains)]
    return rated.select("doc_id", "tokens", *posterior, "rate", "copies", F.lit(facts["residual"]).alias("residual"))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.with_digest(table(spark, sf_dir, "documents")).select("doc_id", *matroska.DIGEST.names)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return forest.search(rows, rows.where("vec_id % 20 = 0"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = bpe.load(tokenizer_path())
    return bpe.with_tokens(table(spark, sf_dir, "documents"), spec, ids=False, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = bpe.with_tokens(table(spark, sf_dir, "documents"), bpe.load(tokenizer_path()), ids=False)
    return lengths.suffix_sums(lengths.histogram(counted))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_sharding, op3_language, op4_mixing, op5_matroska, op6_simhash, op7_forest, op8_bpe, op9_licenses, op10_lengths)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op9_licenses": _licenses_sql()}


def _licenses_sql() -> str:
    """Brute force over every line and template."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    sets = [(label, sorted(set(t.split()))) for label, t in licenses.TEMPLATES]
    templates = ", ".join(f"({i}, '{label}', {quoted(words)}, {licenses.needed(len(words))})" for i, (label, words) in enumerate(sets))
    gap = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'"
    low = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = lambda c: f"list_filter(string_split(regexp_replace({low(c)}, {gap}), ' '), lambda x: x <> '')"
    places = "list_concat(" * (len(licenses.PHRASES) - 1)
    for n, (phrase, label) in enumerate(licenses.PHRASES):
        test = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split()))
        places += f"{', ' if n else ''}list_transform(list_filter(range(1, len(w) + 1), lambda i: {test}), lambda i: {{'at': i - 1, 'label': '{label}'}}){')' if n else ''}"
    return f"""
    WITH texts AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
    lines AS (SELECT t, unnest(string_split(t, chr(10))) AS line FROM texts),
    blocks AS (SELECT t, list_distinct({split("line")}) AS b FROM lines),
    templates(no, label, words, needed) AS (VALUES {templates}),
    met AS (SELECT t, no, label, max(len(list_intersect(b, words))) AS shared, len(any_value(words)) AS size FROM blocks, templates
            WHERE len(list_intersect(b, words)) >= needed GROUP BY t, no, label),
    ranked AS (SELECT *, label LIKE '{licenses.CLOSEST}%' AS close, row_number() OVER (PARTITION BY t, label LIKE '{licenses.CLOSEST}%' ORDER BY 2 * shared - size DESC, label DESC) AS place FROM met),
    best AS (SELECT t, list(DISTINCT label) FILTER (WHERE NOT close OR place = 1) AS more, max(shared / size::DOUBLE) AS best FROM ranked GROUP BY t),
    own AS (SELECT t, {split("t")} AS w FROM texts),
    based AS (SELECT t, len(w) AS n_words, {places} AS places FROM own),
    told AS (SELECT t, n_words, len(places) AS n_base, list_transform(places, lambda p: p.at) AS places_at, list_distinct(list_transform(places, lambda p: p.label)) AS base FROM based)
    SELECT doc_id, n_words, n_base, list_min(places_at) AS first_word, list_max(places_at) AS last_word,
           coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ','), '') AS labels,
           CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
    FROM documents JOIN told ON told.t = coalesce(documents.text, '') LEFT JOIN best USING (t)"""
