"""Tokens and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore of any script.
TOKEN = r"[\p{L}\p{N}_]+"
#: White space of any script, as a class of characters.
SPACE = "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def tokens(text: Column) -> Column:
    """Tokens in lower case; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def stems(text: Column, length: int = 6) -> Column:
    """Tokens cut to their first letters, enough to match inflected forms."""
    return F.transform(tokens(text), lambda t: F.substring(t, 1, length))


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def n_words(text: Column) -> Column:
    """Runs of characters between white space of any kind."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+"))


def n_chars(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def token_count(words: Column, chars: Column) -> Column:
    """Approximate number of model tokens: words, or a quarter of the characters if that is more."""
    return F.greatest(words.cast("long"), F.floor(chars / 4).cast("long"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors between 0 and 1; a zero vector counts as of length 1."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    def norm(x: Column) -> Column:
        n = F.sqrt(dot(x, x))
        return F.when(n == 0, 1.0).otherwise(n)

    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b))))
