"""License scans: phrase places, and an exact set-similarity join of text blocks with templates.

Blocks are the lines of a text and, so that nothing depends on where lines are wrapped, every run of
consecutive words of the whole text that is as long as the template with room for ``1 - threshold`` of
other words. A block meets a template when it holds at least ``threshold`` of the template's distinct
words. The join is exact: a text with such a block holds those words itself, so texts are joined first.
Words are ordered by their frequency over all texts, rarest first; a text that holds enough of a
template must share one of the template's first ``size - needed + 1`` words (prefix filter), have at
least ``needed`` words of any template (length filter), and have enough words left behind the first
shared one in both orders (positional filter); what remains is verified block by block. Everything runs
as DataFrame expressions; only the templates, which are a fixed list, are broadcast.

Notices of the Creative Commons licenses differ in a word or two, so one that holds also meets others; of
these templates a text gets the label of the one that it is closest to.

Defined cases: a null text is an empty one, with no words and no label; words cross lines for the
templates as for the phrases; repeated words count once for the templates and each time for phrases;
equal texts share their result; an empty table gives no row.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlmill.llm.common import cut, lookup

#: What separates words, before and after A-Z are lower-cased.
GAP_ANY, GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Templates: opening sentences of public licenses, as their projects ask for them, and usual notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
)
#: How the labels begin of which a text gets only the closest.
CLOSEST = "cc-"
THRESHOLD = 0.8


def lowered(text: Column) -> Column:
    """A-Z lower-cased, where only ASCII letters matter: two letters whose lower case has an ASCII letter are kept."""
    kept = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text.rlike("[İK]"), kept).otherwise(F.lower(text))


def needed(size: int, threshold: float = THRESHOLD) -> int:
    """How many of a template's words a block must hold."""
    return next(n for n in range(size + 1) if n >= threshold * size - 1e-9)


def template_table(spark: SparkSession, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    rows = [(i, label, sorted(set(text.split())), ceil(len(text.split()) / threshold - 1e-9)) for i, (label, text) in enumerate(templates)]
    own = [(i, label, words, len(words), needed(len(words), threshold), run) for i, label, words, run in rows]
    return spark.createDataFrame(own, "template int, label string, words array<string>, size int, needed int, run int")


def texts_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows ``(text_id, low)``: texts in lower case; equal texts have equal ids."""
    return docs.select(F.md5(F.col(text).cast("binary")).alias("text_id"), lowered(F.col(text)).alias("low"))


def best_block(words: Column, run: Column) -> Column:
    """How many of a template's ``words`` the best block of a text (``low``, ``all``) holds."""
    lines = F.transform(F.split("low", "\n"), lambda line: F.size(F.array_intersect(words, F.split(line, GAP))))
    # the best run may begin with a word of the template
    starts = F.filter(F.transform(F.col("all"), lambda w, i: F.when(F.array_contains(words, w), i + 1)), lambda i: i.isNotNull())
    runs = F.transform(starts, lambda i: F.size(F.array_intersect(words, F.slice("all", i, run))))
    return F.greatest(F.array_max(lines), F.array_max(runs))


def prefix_words(docs: DataFrame, text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> tuple[list[tuple[str, int, int]], list[str]]:
    """Rows ``(word, template, place)`` of the templates' prefixes, and all template words, rarest in the texts first."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    known = F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string"))
    words = texts_of(docs, text).select(F.explode(F.array_distinct(F.split("low", GAP))).alias("word"))
    seen = {r["word"]: r["count"] for r in words.join(known, "word").groupBy("word").count().collect()}  # one row per template word
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefix = []
    for i, (_, t) in enumerate(templates):
        own = sorted(set(t.split()), key=rank.__getitem__)
        prefix += [(w, i, at) for at, w in enumerate(own[: len(own) - needed(len(own), threshold) + 1])]
    return prefix, order


def any_of(prefix: list[tuple[str, int, int]]) -> Column:
    return F.array(*[F.lit(w) for w in sorted({p[0] for p in prefix})])


def containment_join(docs: DataFrame, text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, plan: tuple | None = None) -> DataFrame:
    """Rows ``(text_id, template, label, containment, overlap, size, n)``: all templates that a text's blocks
    meet, with the best block's share and words; n rows have the text. plan: what ``prefix_words`` gave."""
    spark = docs.sparkSession
    known = template_table(spark, templates, threshold)
    texts = texts_of(docs, text)
    prefix, order = plan or prefix_words(docs, text, templates, threshold)
    index = spark.createDataFrame(prefix, "word string, template int, at int")
    first = any_of(prefix)
    everything = F.array(*map(F.lit, order))
    hit = texts.where(F.arrays_overlap(F.split("low", GAP), first))
    ordered = hit.withColumn("own", F.array_intersect(everything, F.split("low", GAP)))  # the text's template words, rarest first
    met = ordered.withColumn("word", F.explode(F.array_intersect(F.col("own"), first))).join(F.broadcast(index), "word").join(F.broadcast(known), "template")
    here = F.array_position("own", F.col("word")).cast("int") - 1
    shared = F.array_intersect("words", "own")
    # of a pair's shared prefix words only the first in the order carries it on; it has no shared word before it
    alone = F.size(F.array_intersect(F.slice("own", F.lit(1), here), F.col("words"))) == 0
    left = 1 + F.least(F.col("size") - F.col("at") - 1, F.size("own") - here - 1)
    verified = met.where((F.size("own") >= F.col("needed")) & alone & (left >= F.col("needed"))).where(F.size(shared) >= F.col("needed"))
    # exploded, so that a block is searched once and not again for the condition
    verified = verified.withColumn("all", F.split("low", GAP)).withColumn("overlap", F.explode(F.array(best_block(F.col("words"), F.col("run"))))).where("overlap >= needed")
    best = [F.max(F.col("overlap") / F.col("size")).alias("containment"), F.max("overlap").alias("overlap"), F.max("size").alias("size"), F.count("*").alias("n")]
    return verified.groupBy("text_id", "template", "label").agg(*best)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Rows ``key, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    plan = prefix_words(docs, text, templates, threshold)
    close = F.col("label").startswith(CLOSEST)
    met = containment_join(docs, text, templates, threshold, plan).groupBy("text_id").agg(
        F.collect_set(F.when(~close, F.col("label"))).alias("more"), F.max("containment").alias("best"), F.max("n").alias("n"),
        F.max(F.when(close, F.struct((2 * F.col("overlap") - F.col("size")).alias("k"), F.col("label")))).alias("closest"),
    )
    one = F.when(F.col("closest").isNotNull(), F.array("closest.label")).otherwise(F.array().cast("array<string>"))
    found = cut(met.select("text_id", F.concat("more", one).alias("more"), "best", "n"))
    body = F.coalesce(F.col(text), F.lit(""))
    pieces = F.col("__pieces")
    n_words = F.size(pieces) - F.when(pieces[0] == "", 1).otherwise(0) - F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)
    any_phrase = "(?i)" + "|".join(p.replace(" ", GAP_ANY) for p, _ in PHRASES)

    def starts(phrase: str, label: str) -> Column:
        words = phrase.split()
        own = F.col("low")
        same = lambda i: [F.get(own, i + k) == w for k, w in enumerate(words)]
        both = lambda i: same(i)[0] & same(i)[1] & (same(i)[2] if len(words) > 2 else F.lit(True))
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(own) - len(words), F.lit(0))), lambda i: F.coalesce(both(i), F.lit(False)))
        return F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    none = F.array().cast("array<struct<at:bigint,label:string>>")
    split = docs.select(F.col(key), F.md5(F.col(text).cast("binary")).alias("__id"), F.split(lowered(body), GAP).alias("__pieces"), body.rlike(any_phrase).alias("__any"))
    # only texts with a prefix word look up what they met; the others don't gather at their copies
    text_id = F.when(F.arrays_overlap(pieces, any_of(plan[0])), F.col("__id")).alias("text_id")
    rows = split.select(key, text_id, n_words.cast("long").alias("n_words"), F.when(F.col("__any"), F.filter(pieces, lambda w: w != "")).alias("low"))
    rows = rows.withColumn("places", F.when(F.col("low").isNull(), none).otherwise(F.concat(*[starts(p, x) for p, x in PHRASES]))).drop("low")
    joined = lookup(rows, found, "text_id")
    base = F.array_distinct(F.col("places.label"))
    more = F.coalesce(F.col("more"), F.array().cast("array<string>"))
    place = F.col("places.at")
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.col("best"), F.lit(0.0)))
    return joined.select(
        F.col(key), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"), score.alias("score"),
    )
