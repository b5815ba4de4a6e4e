"""Text columns: normal form, hash, cleaning, tokens and n-grams (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and digits of every script; every Unicode space plus U+001C..U+001F.
NOT_ALNUM = r"[^\p{L}\p{N}]+"
SPACES = r"(?U)[\s\x1c-\x1f]+"
OUTER_SPACES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
WORD = r"[\p{L}\p{N}_]{2,}"
ZERO_WIDTH = "\u200b\u200c\u200d\u200e\u200f\ufeff"
NBSP = "\u00a0"


def normalize_text(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), NOT_ALNUM, "")


def text_hash(text: Column) -> Column:
    """SHA-256 of the normal form, in hex."""
    return F.sha2(normalize_text(text), 256)


def strip_spaces(text: Column) -> Column:
    """Trim every Unicode space (plain `trim` removes U+0020 only)."""
    return F.regexp_replace(text, OUTER_SPACES, "")


def clean_text(text: Column) -> Column:
    """Classifier input: no zero-width marks, lower case, single spaces, never null."""
    visible = F.translate(F.coalesce(text, F.lit("")), NBSP + ZERO_WIDTH, " ")
    return F.trim(F.regexp_replace(F.lower(visible), SPACES, " "))


def word_tokens(clean: Column) -> Column:
    """Words of two or more characters, in order."""
    return F.regexp_extract_all(clean, F.lit(WORD), F.lit(0))


def word_bigrams(tokens: Column) -> Column:
    """Neighbouring token pairs joined by a space."""
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), pairs),
        F.slice(tokens, F.lit(2), pairs),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )


def space_words(clean: Column) -> Column:
    """Words between single spaces of a cleaned text."""
    return F.filter(F.split(clean, " "), lambda w: w != "")
