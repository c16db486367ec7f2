"""Language identification of mixed texts: script ranges, per-word scores, Viterbi over languages.

A word's script narrows the languages it can be in: those that were met in that script. The path never
gives a word to another one. A word's score in each comes from how often the word and its letter
trigrams were met in that language. The best path over a text's words, with a penalty for each change
of language, labels spans; the text's language is the one that covers most of its words.

Words are runs of letters. A run is cut where its script changes, and in scripts that don't separate
words into stretches of ``UNIT`` letters, so that a long run weighs as much as the words it stands for.

Defined cases: a null text, or one without a letter (numbers and signs are none), is ``und`` with score 0
and no spans; ties go to the language first in alphabetical order; a word in a script that no learned
language uses tells nothing; rows with a null language are not learned from; of rows with equal id and
language one is; with no row to learn from all is ``und``.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from math import log

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlmill.llm.common import cut, frames, labelled_texts, share

#: Bounds of the fit, whatever the size of the corpus: rows learned from, and words kept per language (None: all).
MAX_ROWS, MAX_WORDS = 12_000, 20_000
#: What a change of language costs, how much a word can speak against a language, and what rules one out.
SWITCH, CLIP, RULED_OUT = 12.0, 6.0, -1e4
#: Words whose scores a Python worker remembers, from one task to the next.
KEPT_WORDS = 300_000
#: Runs of letters and other numerals; most texts have no such numeral, so the exact pattern is seldom needed.
WORD, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
#: Letters that may need cutting: all but Latin ones.
FOREIGN = re.compile("[\u0370-\u1dff\u2c80-\ua71f\ua800-\ufaff\ufb13-\ufeff\uff66-\uffdf\U00010000-\U0010ffff]")
#: Letters of a stretch in scripts without spaces.
UNIT = 2
UNSPACED = {"Han", "Kana", "Thai", "Lao", "Tibetan", "Myanmar", "Khmer"}
#: First code points of Unicode script ranges, with the script from there on.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Other"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Other"), (0x1780, "Khmer"), (0x1800, "Other"), (0x1C80, "Cyrillic"),
    (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C80, "Other"),
    (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"),
    (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
)
_STARTS = [s for s, _ in SCRIPTS]


def script(word: str) -> str:
    """The script of a word's first letter."""
    return SCRIPTS[bisect.bisect_right(_STARTS, ord(word[0])) - 1][1]


def words_of(text: str | None) -> list[str]:
    """A text's words, in lower case."""
    text = (text or "").lower()
    words = WORD.findall(text)
    if not "".join(words).isalpha():
        words = LETTERS.findall(text)
    if not FOREIGN.search(text):
        return words
    return [x for w in words for x in ([w] if not FOREIGN.search(w) else _cut(w))]


def _cut(run: str) -> Iterator[str]:
    for name, letters in groupby(run, script):
        own = "".join(letters)
        if name in UNSPACED:
            yield from (own[i : i + UNIT] for i in range(0, len(own), UNIT))
        else:
            yield own


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    words: dict[str, tuple[int, ...]]  # of each kept word, its count in each language
    trigrams: dict[str, tuple[int, ...]]
    scripts: dict[str, tuple[int, ...]]  # of each script, the languages (by index) that it can be


def build(counts: dict[str, dict[str, int]]) -> Model:
    """A model from ``counts[language][word]``."""
    languages = tuple(sorted(counts))
    words: dict[str, list[int]] = defaultdict(lambda: [0] * len(languages))
    trigrams: dict[str, list[int]] = defaultdict(lambda: [0] * len(languages))
    scripts: dict[str, list[int]] = defaultdict(lambda: [0] * len(languages))
    for k, language in enumerate(languages):
        for word, n in counts[language].items():
            words[word][k] += n
            scripts[script(word)][k] += n
            padded = f"^{word}$"
            for i in range(len(padded) - 2):
                trigrams[padded[i : i + 3]][k] += n
    able = {s: tuple(k for k in range(len(languages)) if n[k]) for s, n in scripts.items()}
    return Model(languages, {w: tuple(n) for w, n in words.items()}, {g: tuple(n) for g, n in trigrams.items()}, able)


class Labeller:
    """Labels texts with a model, remembering the scores of words already met."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        k = len(model.languages)
        word_total = [sum(n[i] for n in model.words.values()) + 1 for i in range(k)]
        gram_total = [sum(n[i] for n in model.trigrams.values()) + len(model.trigrams) + 1 for i in range(k)]
        self.words = {w: [log((n + 0.1) / t) for n, t in zip(own, word_total)] for w, own in model.words.items()}
        self.grams = {g: [log((n + 0.5) / t) for n, t in zip(own, gram_total)] for g, own in model.trigrams.items()}
        self.no_gram = [log(0.5 / t) for t in gram_total]
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, k), np.float32)

    def score(self, word: str) -> list[float]:
        """Log-likelihoods of a lower-case word, relative to its best language and clipped; its script rules the other languages out."""
        able = self.model.scripts.get(script(word), ())
        if not able:
            return [0.0] * len(self.model.languages)
        padded, grams, none = f"^{word}$", self.grams, self.no_gram
        like = [sum(x) for x in zip(*[grams.get(padded[i : i + 3], none) for i in range(len(padded) - 2)])]
        if (own := self.words.get(word)) is not None:
            like = [a / 2 + b for a, b in zip(like, own)]
        best = max(like[i] for i in able)
        return [max(x - best, -CLIP) if i in able else RULED_OUT for i, x in enumerate(like)]

    def _ids(self, words: list[str]) -> np.ndarray:
        if len(self.at) > KEPT_WORDS:
            self.at.clear()
            self.table = np.zeros((1024, len(self.model.languages)), np.float32)
        at = self.at
        ids = list(map(at.get, words))
        if None in ids:
            new = [w for w in dict.fromkeys(words) if w not in at]
            start = len(at)
            at.update(zip(new, range(start, start + len(new))))
            while len(self.table) < len(at):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.table[start : len(at)] = [self.score(w) for w in new]
            ids = list(map(at.__getitem__, words))
        return np.array(ids, np.int64)

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The best language of each word under the switching penalty."""
        total = scores.sum(axis=0)
        best = int(np.argmax(total))
        lead = scores - scores[:, best : best + 1]
        sums = np.vstack([np.zeros((1, lead.shape[1])), np.cumsum(lead, axis=0)])
        if (sums - np.minimum.accumulate(sums, axis=0)).max() <= self.switch / 2:
            return np.full(len(scores), best)  # no stretch gains enough elsewhere to pay for a change
        rows, back = scores.tolist(), []
        value = rows[0]
        for row in rows[1:]:  # plain lists: there are only a few languages
            top = max(value)
            at, floor = value.index(top), top - self.switch
            back.append([i if v >= floor else at for i, v in enumerate(value)])
            value = [(v if v >= floor else floor) + s for v, s in zip(value, row)]
        out = [value.index(max(value))]
        for came in reversed(back):
            out.append(came[out[-1]])
        return np.array(out[::-1])

    def label(self, text: str | None) -> tuple[str, float, list[dict]]:
        words = words_of(text)
        if not words or not self.model.languages:
            return "und", 0.0, []
        ids = self._ids(words)
        scores = self.table[ids]
        path = self.path(scores)
        cover = np.bincount(path, minlength=len(self.model.languages))
        best = int(np.argmax(cover))
        edge = np.r_[0, np.flatnonzero(path[1:] != path[:-1]) + 1, len(path)]
        spans = [{"first_word": int(a), "words": int(b - a), "lang": self.model.languages[path[a]]} for a, b in zip(edge, edge[1:])]
        # certainty: the share of its words, weighed by how well the runner-up does on them
        own = scores[path == best].mean(axis=0)
        rest = np.delete(own, best)
        gap = own[best] - rest.max() if len(rest) else CLIP
        return self.model.languages[best], float(cover[best] / len(path) / (1 + np.exp(-2 * gap))), spans


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS, max_words: int | None = MAX_WORDS) -> Model:
    """A model from at most ``max_rows`` rows with a language, and per language its ``max_words`` commonest words.

    Where the words of one frequency would exceed ``max_words``, none of that frequency is kept. None keeps all.
    """
    rows = labelled_texts(docs, key, text, lang, max_rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for language, t in zip(batch["label"], batch["text"]):
                by[language].update(words_of(t))
        yield from frames(((x, w, n) for x, c in by.items() for w, n in c.items()), ["lang", "word", "n"])

    counted = cut(rows.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    least: dict[str, int] = {}
    if max_words is not None:
        kept: Counter = Counter()
        for r in sorted(counted.groupBy("lang", "n").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.n):  # a row per frequency
            kept[r.lang] += r.words
            if kept[r.lang] <= max_words:
                least[r.lang] = r.n
        cuts = F.coalesce(*[F.when(F.col("lang") == k, n) for k, n in least.items()], F.lit(2**62)) if least else F.lit(2**62)
        counted = counted.where(F.col("n") >= cuts)
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in counted.select("lang", "word", "n").collect():
        counts[r.lang][r.word] = r.n
    return build(counts)


def with_label(df: DataFrame, model: Model, text: str = "text", switch: float = SWITCH, to: str = "label") -> DataFrame:
    """``df`` with ``to``, a struct of ``lang_pred``, ``score`` and ``spans`` (first word, words, language); a column of that name is replaced."""
    shared = share(df.sparkSession, Labeller(model, switch))  # bounded by max_words words a language
    span = T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("lang", T.StringType())])

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))]))
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            yield pd.DataFrame([own.label(t) for t in batch], columns=["lang_pred", "score", "spans"])

    return df.withColumn(to, label(F.col(text)))


def predict(df: DataFrame, model: Model, text: str = "text", switch: float = SWITCH) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``spans``; columns of these names are replaced, unless one is the text."""
    names = ("lang_pred", "score", "spans")
    kept = [c for c in df.columns if c not in names]
    return with_label(df, model, text, switch, "__l").select(*kept, *[F.col(f"__l.{n}").alias(n) for n in names])


def held_out(key: Column) -> Column:
    """Whether a row is kept from the fit: CRC-32 of its key as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
