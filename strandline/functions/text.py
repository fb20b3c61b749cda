"""Normalised text and edit-distance rules, as columns.

Patterns use Unicode letters and numbers explicitly: ``\\w`` is ASCII in Java.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; lambdas don't share common subexpressions."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: White space at the ends of a text: Unicode's, and the separators that text tools strip besides.
_SPACE = r"[\s\x1c-\x1f]"


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends; a null stays null."""
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def normalized(text: Column) -> Column:
    """Lower case, signs as spaces, single spaces, trimmed; a null is empty."""
    lowered = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s\x1c-\x1f]+", " ")
    plain = F.regexp_replace(lowered, r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


#: Steps by which the length of a common beginning is found; beyond their sum it's not looked for.
_STEPS = [1 << k for k in range(17, -1, -1)]


def _common_start(a: Column, b: Column) -> Column:
    """Length of the common beginning of two texts, by halving steps."""
    least = F.least(F.length(a), F.length(b))
    same = lambda n, step: (n + step <= least) & (F.substring(a, n + 1, step) == F.substring(b, n + 1, step))
    return F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), lambda n, step: F.when(same(n, step), n + step).otherwise(n))


def _apart(a: Column, b: Column) -> Column:
    """Struct of both texts without their common beginning and end, backwards: as far apart as the texts."""
    def cut(x: Column, n: Column) -> Column:
        return F.substring(x, n + 1, F.greatest(F.lit(0), F.length(x) - n))

    rest = let(_common_start(a, b), lambda n: F.struct(F.reverse(cut(a, n)).alias("a"), F.reverse(cut(b, n)).alias("b")))
    return let(rest, lambda r: let(_common_start(r["a"], r["b"]), lambda n: F.struct(cut(r["a"], n).alias("a"), cut(r["b"], n).alias("b"))))


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance.  Texts that were heard twice begin and end alike mostly: only what is between is compared."""
    return let(_apart(a, b), lambda r: F.levenshtein(r["a"], r["b"]))


def edit_distance_within(a: Column, b: Column, most: Column) -> Column:
    """Edit distance if it is ``most`` at most, else -1: computed in a band of that width, and not at all if lengths differ by more."""
    able = (most >= 0) & (F.abs(F.length(a) - F.length(b)) <= most)
    found = let(_apart(a, b), lambda r: F.call_function("levenshtein", r["a"], r["b"], F.greatest(F.lit(0), most)))
    return F.when(able, found).otherwise(F.lit(-1))


def _similarity(a: Column, b: Column, distance: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a == b, F.lit(1.0))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - distance / longest))
    )


def similarity_of_normalized(a: Column, b: Column) -> Column:
    """1 less the edit distance a character of the longer one; two blanks agree, one doesn't with anything."""
    return _similarity(a, b, edit_distance(a, b))


def similarity_within(a: Column, b: Column, least: Column) -> Column:
    """The similarity of normalised texts if it can be ``least`` or more; else 0 or the similarity."""
    longest = F.greatest(F.length(a), F.length(b))
    # One more than the bound, so that rounding loses nothing.
    most = F.least(longest, F.floor((F.lit(1.0) - least) * longest) + 1).cast("int")
    return _similarity(a, b, let(edit_distance_within(a, b, most), lambda d: F.when(d < 0, longest).otherwise(d)))


def similarity(a: Column, b: Column) -> Column:
    return similarity_of_normalized(normalized(a), normalized(b))


def more_complete_of_normalized(candidate: Column, baseline: Column, least: float = 0.85) -> Column:
    """Whether the candidate goes on beyond a text that it begins like."""
    longer = (F.length(baseline) > 0) & (F.length(candidate) > F.length(baseline))
    beginning = F.trim(F.substring(candidate, F.lit(1), F.length(baseline)))
    return F.when(longer, similarity_of_normalized(beginning, baseline) >= least).otherwise(F.lit(False))


def more_complete(candidate: Column, baseline: Column) -> Column:
    return more_complete_of_normalized(normalized(candidate), normalized(baseline))


def plain_text(texts: Column) -> Column:
    """Stripped texts that aren't blank, joined by spaces."""
    return F.array_join(F.filter(F.transform(texts, lambda t: stripped(F.coalesce(t, F.lit("")))), lambda t: t != ""), " ")


def preview(text: Column, limit: int = 240) -> Column:
    """A text on one line, cut with dots beyond the limit."""
    flat = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit), F.lit("...")))
