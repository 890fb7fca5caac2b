"""Text columns: words, sentences, readability, keywords.  Whitespace is Unicode white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..thresholds import DEFAULTS, Thresholds

#: Words that are no keywords.
STOP_WORDS = (
    "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all would there "
    "their what so up out if about who get which go me when make can like time no just him know take people into year your good some could them see "
    "other than then now look only come its over think also back after use two how our work first well way even new want because any these give day "
    "most us is was are been has had were said did having may should"
).split()
#: Signs stripped from the ends of a word.
EDGE_SIGNS = '.,!?;:"()[]{}'
#: Reading ease from which a grade holds.
GRADES = ((90, "5th Grade"), (80, "6th Grade"), (70, "7th Grade"), (60, "8-9th Grade"), (50, "10-12th Grade"), (30, "College"))
LAST_GRADE = "College Graduate"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Whitespace-separated tokens; none for null and empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))), lambda s: s != "")


def syllables(word: Column) -> Column:
    """Runs of a, e, i, o, u less one for a final e, one at least."""
    low = F.lower(word)
    return F.greatest(F.lit(1), F.regexp_count(low, F.lit("[aeiou]+")) - F.endswith(low, F.lit("e")).cast("int"))


def total_syllables(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda n, w: n + syllables(w))


def reading_ease(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """Flesch reading ease within 0 and 100, unrounded; 0 without words or sentences."""
    score = 206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (n_syllables / n_words)
    return F.when((n_words == 0) | (n_sentences == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def grade(score: Column) -> Column:
    """The grade of an unrounded reading ease."""
    out = F.when(score >= GRADES[0][0], GRADES[0][1])
    for least, name in GRADES[1:]:
        out = out.when(score >= least, name)
    return out.otherwise(LAST_GRADE)


def grade_range(score: Column) -> Column:
    """Text of the integer band that holds a score; bands do not touch, so 89.5 is in none."""
    out, high = None, 100
    for least, name in (*GRADES, (0, LAST_GRADE)):
        text = f"{least}-{high} maps to {name}"
        out = F.when(score.between(least, high), text) if out is None else out.when(score.between(least, high), text)
        high = least - 1
    return out.otherwise("Unknown range")


def strip_edges(word: Column) -> Column:
    return F.btrim(word, F.lit(EDGE_SIGNS))


def keywords(tokens: Column, thresholds: Thresholds = DEFAULTS, stop_words=STOP_WORDS) -> Column:
    """Tokens longer than the minimum (edge signs counted), lower-cased, stripped, less stop words."""
    kept = F.transform(F.filter(tokens, lambda w: F.length(w) > thresholds.min_keyword_length), lambda w: strip_edges(F.lower(w)))
    return F.filter(kept, lambda w: ~w.isin(*stop_words))


def unique_words(tokens: Column) -> Column:
    return F.size(F.array_distinct(F.transform(tokens, F.lower)))


def difficult_words(tokens: Column, thresholds: Thresholds = DEFAULTS) -> Column:
    """Stripped tokens of three characters and syllables or more, in order, repeats included."""
    stripped = F.transform(tokens, lambda w: strip_edges(F.lower(w)))
    return F.filter(stripped, lambda w: (F.length(w) >= 3) & (syllables(w) >= thresholds.difficult_syllables))


def round_half_up(value: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, which other engines reproduce exactly."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale
