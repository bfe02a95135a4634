from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# The characters removed by a whitespace strip.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; NULL where the whole is 0 or missing."""
    return F.try_divide(part, whole) * 100


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def lead_rank(*order: Column) -> Column:
    """1-based position over a table that is already cut to a fixed number of rows.

    The window has no partition key, so it must never see more than a report's
    top-k rows.
    """
    return F.row_number().over(Window.orderBy(*order))


def ordered_text(position: Column | list[Column], text: Column, separator: str) -> Column:
    """Aggregate: texts of a bounded group joined in the order of ``position``."""
    keys = position if isinstance(position, list) else [position]
    rows = F.array_sort(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)
