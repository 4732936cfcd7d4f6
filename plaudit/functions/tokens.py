"""Token arrays as column expressions, so a text never leaves its row or the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

from plaudit.functions.stopwords import is_stop_word

# Java's \w is ASCII only, so the Unicode classes are spelled out.
WORD = r"[\p{L}\p{N}_]+"
ALPHABETIC = r"^\p{L}+$"

# White space of every script, as a class that Java and RE2 read alike.
SPACES = r"[\t-\r\x1c-\x20\x85\p{Z}]+"


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: str | Column) -> Column:
    """Lower-cased runs of word characters; a null text has no words."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def alphabetic_words(text: str | Column) -> Column:
    """Lower-cased tokens between white space that hold letters only."""
    text = F.col(text) if isinstance(text, str) else text
    pieces = F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES)
    return F.filter(pieces, lambda piece: piece.rlike(ALPHABETIC))


def without_stop_words(tokens: str | Column, stop_words: Iterable[str]) -> Column:
    stop_words = list(stop_words)
    return F.filter(tokens, lambda token: ~is_stop_word(token, stop_words))


def bag(tokens: Column) -> Column:
    """Array of (term, n) for one token array, ordered by term.

    The tokens are sorted inside the row and cut where the term changes, so counting the terms
    of a document needs no shuffle, however long the document is.
    """
    def starts(ordered: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(ordered), F.lit(1)))
        return F.filter(places, lambda i: F.get(ordered, i - 1).isNotNull() & (
            (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2))))

    def runs(ordered: Column, first: Column) -> Column:
        return F.transform(first, lambda i, k: F.struct(
            F.get(ordered, i - 1).alias("term"),
            (F.coalesce(F.get(first, k + 1), F.size(ordered) + 1) - i).cast("long").alias("n")))

    return _bind(F.sort_array(tokens), lambda ordered: _bind(
        starts(ordered), lambda first: runs(ordered, first)))
