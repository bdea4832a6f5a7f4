"""Column expressions over review text. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split and \s treat as white space (Java's \s is ASCII only).
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Only \n ends a match of "." in Python; Java's "." also stops at other line ends.
TAG_PATTERN = r"<[^\n]*?>"
# Maximal runs of two or more word characters.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
MIN_LENGTH = 10

def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def replace_tags(text: Column | str, by: str = " ") -> Column:
    """Markup tags replaced by ``by``; null becomes the empty string."""
    return F.regexp_replace(F.coalesce(_col(text), F.lit("")), TAG_PATTERN, by)


def _blanked(text: Column | str) -> Column:
    """Every white space character as a blank: one lookup per character, no pattern."""
    return F.translate(F.coalesce(_col(text), F.lit("")), WHITESPACE, " " * len(WHITESPACE))


def squeeze(text: Column | str) -> Column:
    """White space runs become one blank and the ends are trimmed."""
    return F.trim(F.regexp_replace(_blanked(text), " {2,}", " "))


def first_tokens(squeezed: Column | str, max_tokens: int | None = None) -> Column:
    """The first ``max_tokens`` tokens of an already squeezed text, all of them by default."""
    text = _col(squeezed)
    return text if max_tokens is None else F.substring_index(text, " ", max_tokens)


def clean_text(text: Column | str, max_tokens: int | None = None, tag: str = " ") -> Column:
    """Tags out, white space squeezed; cut to ``max_tokens`` tokens only if that is given."""
    return first_tokens(squeeze(replace_tags(text, tag)), max_tokens)


def tokens(text: Column | str) -> Column:
    """Tokens between white space, case kept, without empty ones."""
    return F.array_remove(F.split(_blanked(text), " "), "")


def words(text: Column | str, stop_words: Sequence[str] = ()) -> Column:
    """Lower-case words of two or more word characters, stop words removed."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))
    if not stop_words:
        return found
    return F.filter(found, lambda word: ~word.isin(*stop_words))


def text_length(text: Column | str) -> Column:
    return F.length(F.coalesce(_col(text), F.lit(""))).cast("long")


def word_count(text: Column | str) -> Column:
    return F.size(tokens(text)).cast("long")


def long_enough(text: Column | str, min_length: int = MIN_LENGTH) -> Column:
    return F.length(_col(text)) >= min_length
