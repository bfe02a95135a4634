from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import strip

WORD = r"[\p{L}\p{N}]+"
SENTENCE = r"[^.!?\n]+[.!?]*"


def delimited_items(names: Column) -> Column:
    """Items of a comma-delimited string, stripped; NULL for a missing list."""
    return F.transform(F.split(names, ","), strip)


def words(text: Column, min_length: int = 1) -> Column:
    """Lower-case words of a text in reading order."""
    pattern = WORD if min_length == 1 else r"[\p{L}\p{N}]{%d,}" % min_length
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def raw_sentences(text: Column) -> Column:
    """Sentences in reading order with the white space around them, blank ones too. A line feed ends a sentence."""
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences in reading order. A line feed ends a sentence too; blanks are dropped."""
    return F.filter(F.transform(raw_sentences(text), strip), lambda s: F.length(s) > 0)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often and deep it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)
