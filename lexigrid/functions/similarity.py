"""Similarity scalars. All but the sequence ratio are built of array functions."""

from __future__ import annotations

from difflib import SequenceMatcher
from unicodedata import normalize as normalize_unicode

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..lexicon import PREFIXES, Lexicon
from .text import compact_ngrams, normalize, tokenize


def dice(a: Column, b: Column) -> Column:
    """Of arrays without repeats; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays as sets; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def boundary_contains(haystack: Column, needle: Column) -> Column:
    """Whether the needle stands in the haystack with a space or an end on both sides (normalized texts)."""
    return F.contains(F.concat(F.lit(" "), haystack, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def containment(q: Column, a: Column) -> Column:
    """Bonus of a normalized text of four characters or more that the other contains."""
    one = lambda short, long: F.when((F.length(short) >= 4) & boundary_contains(long, short), F.least(F.lit(0.92), F.length(short) / F.greatest(F.length(long), F.lit(1)) + 0.25)).otherwise(0.0)
    return F.greatest(one(q, a), one(a, q))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; Spark has no function for it."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility form of Unicode; Spark has no function for it."""
    return pd.Series([None if x is None else normalize_unicode("NFKC", x) for x in s], dtype=object)


def composed(c: Column) -> Column:
    """The text in NFKC. Texts of ASCII are that already and never leave the JVM."""
    return F.coalesce(nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def grams(norm: Column, n: int) -> Column:
    return compact_ngrams(F.replace(norm, F.lit(" "), F.lit("")), n)


def built_in_part(q: Column, a: Column, lexicon: Lexicon) -> Column:
    """What bigrams, trigrams and tokens add to the similarity of two normalized texts."""
    tokens = lambda c: F.array_distinct(tokenize(c, lexicon))
    return 0.25 * dice(grams(q, 2), grams(a, 2)) + 0.2 * dice(grams(q, 3), grams(a, 3)) + 0.2 * jaccard(tokens(q), tokens(a))


def string_similarity(query: Column, alias: Column, lexicon: Lexicon) -> Column:
    q, a = normalize(query), normalize(alias)
    mixed = F.greatest(containment(q, a), 0.35 * sequence_ratio(q, a) + built_in_part(q, a, lexicon))
    return F.when((q == "") | (a == ""), 0.0).when(q == a, 1.0).otherwise(mixed)


def modifier_match(terms: Column, alias_text: Column) -> Column:
    """Share of the terms that occur in the aliases' joined text; 1 without terms."""
    hit = F.size(F.filter(terms, lambda t: F.contains(alias_text, normalize(t))))
    return F.when(F.size(terms) == 0, 1.0).otherwise(hit / F.size(terms))


def stem_match(a: Column, b: Column) -> Column:
    """Equal; or one of five letters or more begins the other; or all but two letters, six at least, agree."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    m = F.greatest(F.lit(6), F.length(short) - 2)
    return (a == b) | ((F.length(short) >= 5) & F.startswith(long, short)) | ((F.length(short) >= 6) & (F.left(a, m) == F.left(b, m)))


def content_overlap(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b) | F.exists(a, lambda x: F.exists(b, lambda y: stem_match(x, y)))


def prefix_stem(t: Column) -> Column:
    """The token without its first fitting prefix of the list, if five letters stay; else null."""
    out = F.when(F.lit(False), t)
    for p in PREFIXES:
        out = out.when(F.startswith(t, F.lit(p)) & (F.length(t) - len(p) >= 5), F.substring(t, F.lit(len(p) + 1), F.length(t)))
    return out


def affix_mismatch(query: Column, candidate: Column) -> Column:
    """Whether a prefixed token of the query is missing from the candidate, which has the bare stem."""

    def bare(x: Column, stem: Column) -> Column:
        longer = F.exists(candidate, lambda c: (F.length(c) >= 5) & F.startswith(c, stem) & ~F.contains(c, x))
        return F.array_contains(candidate, stem) | longer

    return F.exists(query, lambda x: prefix_stem(x).isNotNull() & ~F.array_contains(candidate, x) & bare(x, prefix_stem(x)))


def name_within(a: Column, b: Column) -> Column:
    return (a == b) | F.contains(a, b) | F.contains(b, a)


