"""Text cleaning, keyword sets and term vectors as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode has it, and the four separators among the control characters.
BLANK_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
LETTER = r"[\p{L}\p{N}_]"
WORD = LETTER + "{2,}"
# What normalising and splitting leave of a text, words of three or more only.
KEYWORD = r"[a-z0-9+#]{3,}"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda of a higher-order function re-evaluates every outer expression it
    names for each element. Passing the value through a one-element array turns
    it into a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(text, BLANK_ENDS, "")


def string_array(values: Sequence[str]) -> Column:
    """Constant array; one literal that the optimizer splits once, not one per value."""
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit("\n".join(values)), "\n")


def computed_once(*columns: Column) -> Column:
    """Named columns for ``select`` that later filters and sums never recompute.

    The optimizer merges projections and so repeats an expression for each use; it
    does not move expressions through a generator.
    """
    return F.inline(F.array(F.struct(*columns)))


def or_empty(values: Column) -> Column:
    """A string list that is never NULL."""
    return F.coalesce(values, F.array().cast("array<string>"))


def lowered(text: Column) -> Column:
    """Lower-cased text; empty when missing."""
    return F.lower(F.coalesce(text, F.lit("")))


def normalize_text(text: Column) -> Column:
    """Lower-case, keep ``a-z 0-9 + #``, single blanks between words."""
    kept = F.regexp_replace(lowered(text), r"[^a-zA-Z0-9\s+#]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def keyword_set(text: Column, stop_words: Sequence[str]) -> Column:
    """Distinct words of the normalised text, longer than two and not stop words.

    Reads the words straight from the lower-cased text, which saves the
    replacements and the split of :func:`normalize_text`.
    """
    return F.array_except(F.regexp_extract_all(lowered(text), F.lit(KEYWORD), F.lit(0)), string_array(stop_words))


def tokens(text: Column, stop_words: Sequence[str]) -> Column:
    """Words of two or more word characters, in order, without stop words."""
    words = F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def unigrams_and_bigrams(words: Column) -> Column:
    """The words followed by every pair of neighbours."""
    return bind(words, lambda w: F.concat(
        w,
        F.filter(
            F.zip_with(w, F.slice(w, F.lit(2), F.size(w)),
                       lambda a, b: F.concat(a, F.lit(" "), b)),
            lambda pair: pair.isNotNull(),
        ),
    ))


def term_counts(terms: Column) -> Column:
    """``array<struct<term, tf>>`` sorted by term, counted inside the row.

    Counting by run lengths of the sorted array needs no shuffle, unlike
    explode + groupBy on (document, term).
    """

    empty = F.array().cast("array<struct<term:string,tf:int>>")

    def from_sorted(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        counted = bind(starts, lambda st: F.transform(st, lambda p, k: F.struct(
            F.get(s, p).alias("term"),
            (F.coalesce(F.get(st, k + 1), F.size(s)) - p).alias("tf"),
        )))
        return F.when(F.size(s) > 0, counted).otherwise(empty)

    return bind(F.sort_array(terms), from_sorted)


def join_text(*parts: Column) -> Column:
    """Parts joined by single blanks; a missing part counts as empty text."""
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])
