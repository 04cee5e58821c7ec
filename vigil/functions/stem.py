"""Porter's stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980) as column expressions.

A consonantal y is written Y on the way, so that vowels and the measure m, the number of vowel-consonant sequences, are
plain patterns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWEL = "[aeiouy]"
M_OVER_0 = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
M_OVER_1 = "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]"
#: Two equal consonants at the end; a consonant, a vowel and a consonant other than w, x, Y.
DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|ll|mm|nn|pp|qq|rr|ss|tt|vv|ww|xx|zz)$"
SHORT = "[^aeiouy][aeiouy][^aeiouywxY]$"

# The suffixes of steps 2 to 4 and what replaces them, longer ones before those they end with.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _first(word: Column, rules: list[tuple[Column, Column]]) -> Column:
    """The outcome of the first rule that holds, else the word."""
    return reduce(lambda c, r: c.when(*r), rules[1:], F.when(*rules[0])).otherwise(word)


def _without(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _swapped(word: Column, suffixes: tuple[tuple[str, str], ...], holds: str) -> Column:
    rules = []
    for suffix, new in sorted(suffixes, key=lambda s: -len(s[0])):
        rest = _without(word, len(suffix))
        rules.append((word.endswith(suffix), F.when(rest.rlike(holds), F.concat(rest, F.lit(new))).otherwise(word)))
    return _first(word, rules)


def steps() -> list:
    """The steps in order, each from a column to a column."""

    def marked(w: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiou])y", "$1Y")

    def plural(w: Column) -> Column:
        return _first(w, [(w.endswith("sses") | w.endswith("ies"), _without(w, 2)), (w.endswith("ss"), w), (w.endswith("s"), _without(w, 1))])

    def past(w: Column) -> Column:
        # a stripped ending leaves a mark for the next step
        rules = [(w.endswith("eed"), F.when(_without(w, 3).rlike(M_OVER_0), _without(w, 1)).otherwise(w))]
        rules += [(w.endswith(s) & _without(w, len(s)).rlike(VOWEL), F.concat(_without(w, len(s)), F.lit("+"))) for s in ("ed", "ing")]
        return _first(w, rules)

    def mended(w: Column) -> Column:
        rest = F.rtrim(w, F.lit("+"))
        short = rest.rlike(M_OVER_0) & ~rest.rlike(M_OVER_1) & rest.rlike(SHORT)
        fixed = _first(rest, [(rest.rlike("(at|bl|iz)$") | (short & ~rest.rlike(DOUBLE)), F.concat(rest, F.lit("e"))), (rest.rlike(DOUBLE) & ~rest.rlike("[lsz]$"), _without(rest, 1))])
        return F.when(w.endswith("+"), fixed).otherwise(w)

    def final_y(w: Column) -> Column:
        return F.when(w.rlike("[yY]$") & _without(w, 1).rlike(VOWEL), F.concat(_without(w, 1), F.lit("i"))).otherwise(w)

    def stripped(w: Column) -> Column:
        rules = []
        for s in sorted(STEP_4, key=len, reverse=True):
            rest = _without(w, len(s))
            holds = rest.rlike(M_OVER_1) & rest.rlike("[st]$") if s == "ion" else rest.rlike(M_OVER_1)
            rules.append((w.endswith(s), F.when(holds, rest).otherwise(w)))
        return _first(w, rules)

    def final_e(w: Column) -> Column:
        rest = _without(w, 1)
        return F.when(w.endswith("e") & (rest.rlike(M_OVER_1) | (rest.rlike(M_OVER_0) & ~rest.rlike(SHORT))), rest).otherwise(w)

    def final_l(w: Column) -> Column:
        return F.when(w.endswith("ll") & _without(w, 1).rlike(M_OVER_1), _without(w, 1)).otherwise(w)

    return [marked, plural, past, mended, final_y, lambda w: _swapped(w, STEP_2, M_OVER_0), lambda w: _swapped(w, STEP_3, M_OVER_0), stripped, final_e, final_l, F.lower]


def stemmed(words, column: str, out: str):
    """A DataFrame of lower-case words with their stems; meant for distinct words. Words of one or two letters stay."""
    rows = words.withColumn(out, F.col(column))
    for step in steps():
        rows = rows.withColumn(out, step(F.col(out)))
    return rows.withColumn(out, F.when(F.length(column) > 2, F.col(out)).otherwise(F.col(column)))
