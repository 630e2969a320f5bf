"""Text formatting of numbers and dates.

Numbers are rounded with ``round_n`` before they are rendered, so the text
never depends on how an engine rounds a binary value. ``whole`` renders
``%.0f`` with banker's rounding, like Python's ``format(x, '.0f')``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import round_even, round_n


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """``{x:,.2f}``: thousands separator, two decimals."""
    return F.format_number(round_n(_c(c), 2), 2)


def one_decimal(c: Column | str) -> Column:
    """``{x:.1f}``."""
    return F.format_string("%.1f", round_n(_c(c), 1))


def whole(c: Column | str) -> Column:
    """``{x:.0f}`` with half-to-even ties."""
    return round_even(_c(c), 0).cast("bigint").cast("string")


def stamp(c: Column | str) -> Column:
    """``dd.MM.yyyy HH:mm`` of a timestamp or date."""
    return F.date_format(_c(c), "dd.MM.yyyy HH:mm")


def numbered_lines(pos_name: str = "line_no", line_name: str = "line") -> list[Column]:
    """the two output columns of ``posexplode(split(text, '\\n'))``:
    the 1-based line number and the line."""
    return [(F.col("pos") + 1).alias(pos_name), F.col("col").alias(line_name)]


def blank_to(c: Column | str, default: str | Column) -> Column:
    """``(x.strip() or default)``; ``default`` may be a column."""
    t = F.trim(_c(c))
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(t.isNull() | (t == ""), d).otherwise(t)
