"""The suffix stripper for English words of Porter (An algorithm for suffix stripping, 1980), as column expressions.

A word is consonants and vowels, [C](VC)^m[V]; a y after a consonant is a vowel. Each step finds the longest of its
suffixes at the word's end, and strips or replaces it if what stands before it has the measure asked for. A step is a function
of one column; words run through them one transform after the other, so that no step's expression holds another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: The conditions on a stem: it has a vowel, m > 0, m = 1, m > 1; it ends with a double consonant, or consonant, vowel, consonant (not w, x, y).
HAS_VOWEL = "^[^aeiou]*[aeiou]|^[^aeiou]+y"
M_ABOVE_0 = f"^({_C})?{_V}{_C}"
M_IS_1 = f"^({_C})?{_V}{_C}({_V})?$"
M_ABOVE_1 = f"^({_C})?{_V}{_C}{_V}{_C}"
DOUBLE = "(" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwx") + ")$"
SHORT = "[^aeiou][aeiouy][^aeiouwxy]$"

#: The suffixes of steps 1a, 2, 3 and what takes their place; the suffixes that step 4 takes off.
STEP_1A = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

Step = Callable[[Column], Column]


def at_end(suffixes: object) -> str:
    """A pattern of the suffixes at a word's end; the first match from the left is the longest one."""
    return f"({'|'.join(suffixes)})$"


def _before(word: Column, suffix: str) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - len(suffix))


def _replaced(table: dict[str, str], condition: str | None) -> Step:
    """The longest suffix of table replaced where the stem before it meets the condition."""

    def step(word: Column) -> Column:
        out = word
        for suffix, new in sorted(table.items(), key=lambda x: len(x[0])):  # the longest is asked first, so it stands outermost
            stem = _before(word, suffix)
            changed = F.concat(stem, F.lit(new))
            out = F.when(word.endswith(suffix), changed if condition is None else F.when(stem.rlike(condition), changed).otherwise(word)).otherwise(out)
        return out

    return step


def step_1b(word: Column) -> Column:
    """eed to ee where m > 0; ed and ing off after a vowel, marked with a final capital for what follows."""
    eed, ed, ing = (_before(word, x) for x in ("eed", "ed", "ing"))
    return (
        F.when(word.endswith("eed"), F.when(eed.rlike(M_ABOVE_0), F.concat(eed, F.lit("ee"))).otherwise(word))
        .when(word.endswith("ed"), F.when(ed.rlike(HAS_VOWEL), F.concat(ed, F.lit("X"))).otherwise(word))
        .when(word.endswith("ing"), F.when(ing.rlike(HAS_VOWEL), F.concat(ing, F.lit("X"))).otherwise(word))
        .otherwise(word)
    )


def step_1b_mend(word: Column) -> Column:
    """What ed or ing was taken from gets its e back, or loses one of two consonants."""
    stem = _before(word, "X")
    mended = F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e"))).when(stem.rlike(DOUBLE), _before(stem, "x")).when(stem.rlike(M_IS_1) & stem.rlike(SHORT), F.concat(stem, F.lit("e"))).otherwise(stem)
    return F.when(word.endswith("X"), mended).otherwise(word)


def step_1c(word: Column) -> Column:
    stem = _before(word, "y")
    return F.when(word.endswith("y") & stem.rlike(HAS_VOWEL), F.concat(stem, F.lit("i"))).otherwise(word)


def step_4(word: Column) -> Column:
    """The suffix off where m > 1, ion only after s or t."""
    suffix = F.regexp_extract(word, at_end(STEP_4), 1)
    stem = F.substring(word, F.lit(1), F.length(word) - F.length(suffix))
    return F.when((suffix != "") & stem.rlike(M_ABOVE_1) & ((suffix != "ion") | stem.rlike("[st]$")), stem).otherwise(word)


def step_5a(word: Column) -> Column:
    stem = _before(word, "e")
    return F.when(word.endswith("e") & (stem.rlike(M_ABOVE_1) | (stem.rlike(M_IS_1) & ~stem.rlike(SHORT))), stem).otherwise(word)


def step_5b(word: Column) -> Column:
    return F.when(word.endswith("ll") & word.rlike(M_ABOVE_1), _before(word, "l")).otherwise(word)


STEPS: list[Step] = [_replaced(STEP_1A, None), step_1b, step_1b_mend, step_1c, _replaced(STEP_2, M_ABOVE_0), _replaced(STEP_3, M_ABOVE_0), step_4, step_5a, step_5b]


def stems(words: Column) -> Column:
    """The stems of an array of lower-case words; words of one or two characters stay. Letters outside a-z count as consonants."""
    for step in STEPS:
        words = F.transform(words, _of_longer(step))
    return words


def _of_longer(step: Step) -> Step:
    return lambda w: F.when(F.length(w) > 2, step(w)).otherwise(w)


def stem(word: Column) -> Column:
    return F.get(stems(F.array(word)), F.lit(0))


def stems_sql(words: str) -> str:
    """The same of a list in DuckDB's SQL, told by its patterns."""

    def replaced(table: dict[str, str], condition: str | None) -> str:
        arms = []
        for suffix, new in sorted(table.items(), key=lambda x: -len(x[0])):
            head = f"left(w, length(w) - {len(suffix)})"
            changed = f"{head} || '{new}'"
            arms.append(f"WHEN suffix(w, '{suffix}') THEN {changed if condition is None else f'''CASE WHEN regexp_matches({head}, '{condition}') THEN {changed} ELSE w END'''}")
        return f"CASE {' '.join(arms)} ELSE w END"

    has = lambda cut, pattern: f"regexp_matches(left(w, length(w) - {cut}), '{pattern}')"
    cut = lambda n: f"left(w, length(w) - {n})"
    found = f"regexp_extract(w, '{at_end(STEP_4)}', 1)"
    rest = f"left(w, length(w) - length({found}))"
    steps = [
        replaced(STEP_1A, None),
        f"CASE WHEN suffix(w, 'eed') THEN CASE WHEN {has(3, M_ABOVE_0)} THEN {cut(1)} ELSE w END WHEN suffix(w, 'ed') AND {has(2, HAS_VOWEL)} THEN {cut(2)} || 'X' WHEN suffix(w, 'ing') AND {has(3, HAS_VOWEL)} THEN {cut(3)} || 'X' ELSE w END",
        f"CASE WHEN NOT suffix(w, 'X') THEN w WHEN {has(1, '(at|bl|iz)$')} THEN {cut(1)} || 'e' WHEN {has(1, DOUBLE)} THEN {cut(2)} WHEN {has(1, M_IS_1)} AND {has(1, SHORT)} THEN {cut(1)} || 'e' ELSE {cut(1)} END",
        f"CASE WHEN suffix(w, 'y') AND {has(1, HAS_VOWEL)} THEN {cut(1)} || 'i' ELSE w END",
        replaced(STEP_2, M_ABOVE_0),
        replaced(STEP_3, M_ABOVE_0),
        f"CASE WHEN {found} <> '' AND regexp_matches({rest}, '{M_ABOVE_1}') AND ({found} <> 'ion' OR regexp_matches({rest}, '[st]$')) THEN {rest} ELSE w END",
        f"CASE WHEN suffix(w, 'e') AND ({has(1, M_ABOVE_1)} OR ({has(1, M_IS_1)} AND NOT {has(1, SHORT)})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN suffix(w, 'll') AND regexp_matches(w, '{M_ABOVE_1}') THEN {cut(1)} ELSE w END",
    ]
    for step in steps:
        words = f"list_transform({words}, lambda w: CASE WHEN length(w) > 2 THEN {step} ELSE w END)"
    return words
