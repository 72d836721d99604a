"""Analyzers: from a text column to an array of terms, in built-in functions.

A morphological analyzer of a language can take the place of any of them: operators take the analyzer as a
function from a column to an array of strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith.functions.stemming import stems

#: The usual English stop words of text engines.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


def words(text: Column) -> Column:
    """Runs of letters and digits of any script, lower-cased; null and empty texts have none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def keyword(text: Column) -> Column:
    """The text as it is, one term; null and empty texts have none."""
    return F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))


def english(text: Column) -> Column:
    """words without stop words, stemmed."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return stems(F.filter(words(text), lambda w: ~F.array_contains(stop, w)))


def char_grams(text: Column, least: int = 2, most: int = 3) -> Column:
    """All runs of least to most characters of each word, word by word, shorter ones first at each place."""

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(w) - least + 1, F.lit(1)))
        sizes = F.sequence(F.lit(least), F.lit(most))
        grams = F.flatten(F.transform(starts, lambda i: F.transform(sizes, lambda n: F.when(i + n - 1 <= F.length(w), F.substring(w, i, n)))))
        return F.array_compact(grams)

    return F.flatten(F.transform(words(text), of))


def with_synonyms(terms: Column, synonyms: dict[str, list[str]]) -> Column:
    """terms followed by the synonyms of each: a bag of terms, whose places are no longer the text's (operators.synonyms keeps them)."""
    if not synonyms:
        return terms
    table = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k), F.array(*(F.lit(s) for s in v)))))
    more = lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))
    return F.flatten(F.transform(terms, lambda t: F.concat(F.array(t), more(t))))


def highlight(text: Column, terms: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    """text with the words that are terms between two marks."""
    if not terms:
        return text
    found = "|".join(rf"\Q{t}\E" for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}])({found})(?![\p{{L}}\p{{N}}])", f"{before}$1{after}")


def left_by_deletions(word: str, edits: int) -> set[str]:
    """A word of a request and what is left of it after up to edits deletions."""
    out = {word}
    for _ in range(edits):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out
