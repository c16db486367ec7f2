"""Mixing documents to target domain weights, with soft membership.

A table with known domains gives, per word, how much it speaks for each domain. Every document's words
are summed to one posterior over the domains. Then every document gets a rate (how often it should be
used): nonnegative least squares fits the rates so that the expected tokens of each domain,
``sum(rate * tokens * posterior)``, match the targets. The fit is projected gradient descent over all
documents; an iteration is one distributed sum of as many numbers as there are domains. All of it runs
as DataFrame expressions, and a document's posterior and rate are expressions over its own row: texts
are neither shuffled nor joined.

All words count: a word's weights stand at its hash in ``BUCKETS`` places, and words of one place share
them. The gradient is taken in the metric that weighs a document by its tokens, so a rate does not depend
on the length of its document; each domain's residual is scaled by that domain's own curvature.

Defined cases: null and empty texts have no tokens, the prior as posterior and the rate 1; a text with no
known word has the prior; rows with a null domain are not learned from; without any such row there is a
single domain ``all`` and every rate is 1; equal texts have equal rates; a target may be zero; targets
of unknown domains are an error; targets that the documents can't reach, or not in ``ROUNDS`` rounds, leave
the nearest rates found and say so in ``facts`` (``converged``, ``residual``).
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlmill.llm.common import labelled_texts, stored, unit_hash

#: Bounds of the fit, whatever the size of the corpus: labelled rows, and places of word weights.
MAX_ROWS, BUCKETS = 8_000, 16_384
SHARPNESS, TEMPER = 6.0, 0.7
ROUNDS, TOLERANCE = 400, 1e-6
GAP = r"[\s\p{Punct}]+"


@dataclass(frozen=True)
class Weights:
    """Log-odds by place: ``table[domain][place]`` in thousandths, null where no word was met."""

    domains: tuple[str, ...]
    prior: tuple[float, ...]
    table: tuple[tuple[int | None, ...], ...]


def words_of(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), GAP)


def place_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit_domains(docs: DataFrame, domain: str, key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> Weights:
    """Naive Bayes word weights from at most ``max_rows`` rows of known domain."""
    rows = labelled_texts(docs, key, text, domain, max_rows)
    words = rows.select("label", F.explode(words_of(F.col("text"))).alias("word")).where("word <> ''")
    got = words.groupBy("label", place_of(F.col("word")).alias("at")).agg(F.count("*").alias("n")).collect()  # at most BUCKETS a domain
    domains = tuple(sorted({r["label"] for r in got})) or ("all",)
    total = {d: sum(r["n"] for r in got if r["label"] == d) for d in domains}
    by_place: dict[int, dict[str, int]] = {}
    for r in got:
        by_place.setdefault(r["at"], {})[r["label"]] = r["n"]
    table: list[list[int | None]] = [[None] * BUCKETS for _ in domains]
    for at, n in by_place.items():
        like = [log((n.get(d, 0) + 0.5) / (total[d] + 0.5 * len(by_place))) for d in domains]
        mean = sum(like) / len(like)
        for own, x in zip(table, like):
            own[at] = round(1000 * (x - mean))
    everything = max(sum(total.values()), 1)
    return Weights(domains, tuple((total[d] + 1) / (everything + len(domains)) for d in domains), tuple(map(tuple, table)))


def with_members(docs: DataFrame, weights: Weights, text: str = "text", to: str = "member") -> DataFrame:
    """``docs`` with ``to``, a struct of ``tokens`` and of ``p``, the posteriors in the order of ``weights.domains``.

    A document's evidence is its mean weight per known word, made ``SHARPNESS`` times as strong, plus the
    prior: a text half in one domain and half in another belongs to both.
    """
    kept = [c for c in docs.columns if c != to]
    table = [F.from_json(F.lit(json.dumps(own)), "array<int>") for own in weights.table]  # folded to a constant when planned
    words = docs.select(*kept, words_of(F.col(text)).alias("__words"))
    empty = lambda at: F.when(F.element_at("__words", at) == "", 1).otherwise(0)
    tokens = F.size("__words") - empty(1) - F.when(F.size("__words") > 1, empty(-1)).otherwise(0)
    places = F.filter(F.transform("__words", lambda w: F.when(w != "", place_of(w))), lambda at: F.get(table[0], at).isNotNull())
    met = words.select(*kept, tokens.cast("long").alias("__tokens"), places.alias("__places"))
    total = lambda own: F.aggregate("__places", F.lit(0).cast("long"), lambda a, at: a + F.get(own, at))
    sums = [total(own) for own in table]
    mean = [s / F.lit(1000.0) / F.greatest(F.size("__places"), F.lit(1)) for s in sums]
    logits = met.select(*kept, "__tokens", F.array(*[F.lit(SHARPNESS) * m + F.lit(log(p)) for m, p in zip(mean, weights.prior)]).alias("__z"))
    raised = logits.select(*kept, "__tokens", F.transform("__z", lambda z: F.exp(z - F.array_max("__z"))).alias("__e"))
    mass = F.aggregate("__e", F.lit(0.0), lambda a, e: a + e)
    whole = raised.select(*kept, "__tokens", "__e", mass.alias("__mass"))
    p = F.when(F.col("__tokens") > 0, F.transform("__e", lambda e: e / F.col("__mass"))).otherwise(F.array(*[F.lit(x) for x in weights.prior]))
    return whole.select(*kept, F.struct(F.col("__tokens").alias("tokens"), p.alias("p")).alias(to))


def tempered(shares: list[float], power: float = TEMPER) -> list[float]:
    """Target weights between the natural shares (1) and equal ones (0)."""
    raised = [s**power if s > 0 else 0.0 for s in shares]
    return [r / (sum(raised) or 1.0) for r in raised]


def fit_rates(members: DataFrame, k: int, targets: list[float] | None = None, budget: float | None = None, rounds: int = ROUNDS) -> tuple[list[list[float]], dict]:
    """The steps to the rates of ``members(tokens, p)``, and the fit's facts. targets: a weight per domain, adding up to 1.

    Minimises the sum over domains of ``(sum(rate * tokens * p) - target)^2``, each divided by the
    domain's curvature, over rate >= 0, starting from rate 1. A step is what every domain takes from a rate.
    """
    p = [F.col("p")[i] for i in range(k)]
    t = F.col("tokens")
    first = members.agg(F.sum(t).alias("t"), *[F.sum(t * p[i]).alias(f"m{i}") for i in range(k)], *[F.sum(t * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    total = float(first["t"] or 0)
    if not total:
        return [], {"targets": [], "reached": [], "rounds": 0, "residual": 0.0, "converged": True}
    now = [float(first[f"m{i}"]) for i in range(k)]
    weights = tempered([m / total for m in now]) if targets is None else targets
    goal = [(budget or total) * w for w in weights]
    curve = [max(float(first[f"g{i}_{i}"]), 1e-9 * total) for i in range(k)]
    # rows of the scaled Gram matrix bound its largest eigenvalue: a step that never overshoots
    gram = [[float(first[f"g{min(i, j)}_{max(i, j)}"]) / (curve[i] * curve[j]) ** 0.5 for j in range(k)] for i in range(k)]
    size = 1.0 / max(sum(map(abs, row)) for row in gram)
    steps: list[list[float]] = []
    while True:
        off = [(m - g) / c for m, g, c in zip(now, goal, curve)]
        residual = max(abs(m - g) for m, g in zip(now, goal)) / total
        if residual <= TOLERANCE or len(steps) == rounds:
            break
        steps.append([size * x for x in off])
        rated = members.select(rate_of(steps, "p").alias("rate"), "tokens", "p")
        got = rated.agg(*[F.sum(F.col("rate") * t * p[i]).alias(f"m{i}") for i in range(k)]).first()
        now = [float(got[f"m{i}"]) for i in range(k)]
    return steps, {"targets": goal, "reached": now, "rounds": len(steps), "residual": residual, "converged": residual <= TOLERANCE}


def rate_of(steps: list[list[float]], p: str) -> Column:
    """The rate of a document with the posteriors ``p``: every step is taken, and cut at zero, in turn."""
    pull = lambda step: F.aggregate(F.zip_with(step, F.col(p), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    every = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
    return F.aggregate(every, F.lit(1.0), lambda rate, step: F.greatest(F.lit(0.0), rate - pull(step)))


def with_rates(docs: DataFrame, domain: str = "lang", key: str = "doc_id", text: str = "text", targets: dict[str, float] | None = None, keep: list[str] | None = None, to: str = "mix") -> tuple[DataFrame, Weights, dict]:
    """The columns ``keep`` (by default all) of ``docs`` with ``to``, a struct of ``tokens, p, rate, copies``; the word weights; the fit's facts.

    copies: the rate, rounded up or down by a hash of the key, so that its expectation is the rate. A
    column named ``to`` is replaced. The rows are written to the shared folder once, with their
    posteriors; the descent reads two narrow columns of that table.
    """
    weights = fit_domains(docs, domain, key, text)
    if targets is not None and set(targets) - set(weights.domains):
        raise ValueError(f"targets of unknown domains: {sorted(set(targets) - set(weights.domains))}")
    kept = [c for c in (docs.columns if keep is None else keep) if c != to]
    needed = dict.fromkeys([*kept, key, text])
    members = stored(with_members(docs.select(*needed), weights, text, to).select(*kept, *[F.col(key).cast("string").alias("__key")], to))
    wanted = None if targets is None else [targets.get(d, 0.0) / sum(targets.values()) for d in weights.domains]
    steps, facts = fit_rates(members.select(f"{to}.tokens", f"{to}.p"), len(weights.domains), wanted)
    rate = F.when(F.col(f"{to}.tokens") > 0, rate_of(steps, f"{to}.p")).otherwise(F.lit(1.0)) if steps else F.lit(1.0)
    rated = members.select(*kept, "__key", to, rate.alias("__rate"))
    copies = F.floor(F.col("__rate") + unit_hash(F.coalesce(F.col("__key"), F.lit("")), F.lit("copies"))).cast("int")
    mixed = F.struct(F.col(f"{to}.tokens").alias("tokens"), F.col(f"{to}.p").alias("p"), F.col("__rate").alias("rate"), copies.alias("copies"))
    return rated.select(*kept, mixed.alias(to)), weights, facts


def mix(docs: DataFrame, domain: str = "lang", key: str = "doc_id", text: str = "text", targets: dict[str, float] | None = None) -> tuple[DataFrame, Weights, dict]:
    """Rows ``key, tokens, p, rate, copies`` of all documents, the word weights and the fit's facts."""
    rated, weights, facts = with_rates(docs, domain, key, text, targets, [key], "__mix")
    return rated.select(key, *[F.col(f"__mix.{c}").alias(c) for c in ("tokens", "p", "rate", "copies")]), weights, facts
