"""Similarity of name words: a cascade of cheap to dear tests, and token counts of predictions.

The scalar part runs as Arrow-batched pandas UDFs; a batch computes each distinct pair once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.vectors import hashed_vector

# Fixed values.
UNMATCHED = ("from", "and", "for", "the")
PREPOSITIONS = frozenset("about above across after against along among around as at because before behind below beneath beside between beyond by during except for from if in inside into like near of off on onto out outside over past per since so than that though through throughout till to toward under unless until unto up upon via whereas whether while with within without".split())
EDIT, CONFIDENCE, PLACES, LEMMAS, VECTORS = 0.75, 0.65, 3, 0.6, 0.8
MATCH, MISMATCH, GAP_FULL, GAP_SHORT = 2.0, -2.0, -1.0, -3.0


def damerau_levenshtein(a: str, b: str) -> int:
    """Unrestricted edit distance with swaps of neighbours."""
    last: dict[str, int] = {}
    top = len(a) + len(b)
    rows = {-1: [top] * (len(b) + 2), 0: [top, *range(len(b) + 1)]}
    for i, x in enumerate(a, 1):
        row = rows[i] = [top, i] + [0] * len(b)
        above, match = rows[i - 1], 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                match = j
            swap = rows[k - 1][m] + (i - k - 1) + 1 + (j - m - 1) if k and m else top
            row[j + 1] = min(above[j] + (x != y), row[j] + 1, above[j + 1] + 1, swap)
        last[x] = i
    return rows[len(a)][len(b) + 1]


def edit_similarity(a: str, b: str) -> float:
    n = max(len(a), len(b))
    return 1.0 if not n else 1.0 - damerau_levenshtein(a, b) / n


@dataclass(frozen=True)
class Alignment:
    score: float
    confidence: float
    places: tuple[tuple[int, int], ...]  #: matched (full, short) positions, last first


@lru_cache(maxsize=100_000)
def align(full: str, short: str) -> Alignment:
    """Best local alignment of an abbreviation with its full form; of equal cells the first, of equal moves the
    match, then the gap in full, then the gap in short."""
    full, short = full.lower().replace(" ", ""), short.lower().replace(" ", "")
    score = [[0.0] * (len(short) + 1)]
    move = [[0] * (len(short) + 1)]
    top, at = 0.0, (0, 0)
    for i, x in enumerate(full, 1):
        s, m = [0.0], [0]
        for j, y in enumerate(short, 1):
            options = (0.0, score[i - 1][j - 1] + (MATCH if x == y else MISMATCH), score[i - 1][j] + GAP_FULL, s[j - 1] + GAP_SHORT)
            value = max(options)
            s.append(value)
            m.append(options.index(value))
            if value > top:
                top, at = value, (i, j)
        score.append(s)
        move.append(m)
    places, (i, j) = [], at
    while i and j and score[i][j] > 0:
        step = move[i][j]
        if step == 1:
            places.append((i - 1, j - 1))
        i, j = i - (step in (1, 2)), j - (step in (1, 3))
    return Alignment(top, min(1.0, top / (len(short) * MATCH)) if short else 0.0, tuple(places))


def suffix_lemma(word: str) -> str | None:
    """Stand-in for a dictionary of verbs: three letters or more are a known word, and endings fall off if three stay."""
    if not re.fullmatch("[a-z]{3,}", word):
        return None
    return re.sub("(?<=[a-z]{3})(?:ing|ed|es|s)$", "", word)


def trigram_cosine(a: str, b: str) -> float:
    """Stand-in for an encoder's cosine."""
    return float(hashed_vector(a) @ hashed_vector(b))


@dataclass(frozen=True)
class Cascade:
    """``lemma``: word to its verb lemma or None if it is no known word; ``vectors``: cosine of two words. The defaults
    stand in for a dictionary and an encoder; None leaves a test out."""

    lemma: Callable[[str], str | None] | None = suffix_lemma
    vectors: Callable[[str, str], float] | None = trigram_cosine

    def similar(self, right: str, guess: str) -> bool:
        if not right or not guess:
            return right == guess
        if right.strip() == guess.strip() or edit_similarity(right, guess) >= EDIT:
            return True
        if self.lemma and (a := self.lemma(right)) and a == self.lemma(guess):
            return True
        if min(len(right), len(guess)) >= 3 and right not in PREPOSITIONS and guess not in PREPOSITIONS:
            a, b = (w.replace("_", " ").replace("-", " ") for w in (right, guess))
            if any(m.confidence >= CONFIDENCE and len(m.places) >= PLACES for m in (align(a, b), align(b, a))):
                return True
        if min(len(right), len(guess)) > 1 and (right.startswith(guess) or guess.startswith(right)):
            return True
        if min(len(right), len(guess)) < 3:
            return False
        return bool(self.vectors and self.vectors(right, guess) >= VECTORS)

    def counts(self, right: list[str], guess: list[str]) -> tuple[int, int, int]:
        """True and false positives and false negatives; similar guesses count as the word they resemble."""
        out = list(guess)
        open_ = [j for j, g in enumerate(guess) if g not in right and g not in UNMATCHED]
        for r in right:
            if r in UNMATCHED:
                continue
            for j in list(open_):
                if r != guess[j] and self.similar(r, guess[j]):
                    out[j] = r
                    open_.remove(j)
        if list(right) == out:
            return len(right), 0, 0
        a, b = set(right), set(out)
        return len(a & b), len(b - a), len(a - b)


COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("tp", "fp", "fn")])
ALIGNED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("n_places", T.IntegerType())])


@F.pandas_udf(T.DoubleType())
def edit_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict = {}
    return pd.Series([None if x is None or y is None else known[x, y] if (x, y) in known else known.setdefault((x, y), edit_similarity(x, y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(ALIGNED)
def align_udf(full: pd.Series, short: pd.Series) -> pd.DataFrame:
    got = [align(f or "", s or "") for f, s in zip(full, short, strict=True)]
    return pd.DataFrame({"score": [g.score for g in got], "confidence": [g.confidence for g in got], "n_places": [len(g.places) for g in got]})


@F.pandas_udf(T.BooleanType())
def _similar_udf(right: pd.Series, guess: pd.Series) -> pd.Series:
    cascade = Cascade()
    return pd.Series([cascade.similar(a, b) for a, b in zip(right, guess, strict=True)], dtype="bool")


def is_prefix(a: Column, b: Column) -> Column:
    """Whether one of two words of more than a letter begins with the other."""
    return (F.startswith(a, b) | F.startswith(b, a)) & (F.length(a) > 1) & (F.length(b) > 1)


def _by_pair(rows: DataFrame, a: str, b: str, name: str, known: Column, udf) -> DataFrame:
    """Adds ``name``: ``known`` where it is not null, else ``udf`` of the pair, which each distinct pair meets once."""
    rows = rows.withColumn("_known", known)
    pairs = rows.filter(F.col("_known").isNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    pairs = pairs.withColumn("_got", udf("_a", "_b"))
    return rows.join(pairs, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left").withColumn(name, F.coalesce("_known", "_got")).drop("_known", "_a", "_b", "_got")


def with_similarity(rows: DataFrame, a: str, b: str, name: str = "similarity") -> DataFrame:
    """Adds the edit similarity of two columns; equal words, and a word beside none, never leave the JVM."""
    x, y = F.col(a), F.col(b)
    known = F.when(x == y, F.lit(1.0)).when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0.0))
    return _by_pair(rows, a, b, name, known, edit_similarity_udf)


def with_verdict(rows: DataFrame, right: str, guess: str, name: str = "similar") -> DataFrame:
    """Adds whether the default cascade takes two words for one; what equality, emptiness and prefixes decide never
    leaves the JVM."""
    x, y = F.col(right), F.col(guess)
    known = F.when((x == "") | (y == ""), x == y).when(F.trim(x) == F.trim(y), F.lit(True)).when(is_prefix(x, y), F.lit(True))
    return _by_pair(rows, right, guess, name, known, _similar_udf)


def counts_udf(cascade: Cascade = Cascade()):
    """UDF of (right words, guessed words) to (tp, fp, fn)."""

    @F.pandas_udf(COUNTS)
    def counts(right: pd.Series, guess: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cascade.counts(list(r), list(g)) for r, g in zip(right, guess, strict=True)], columns=["tp", "fp", "fn"])

    return counts


def cosine(a, b):
    """Cosine of two arrays, as a Column."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def jaccard(a, b):
    """Jaccard of two arrays as sets, 0 if either is empty, as a Column."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
