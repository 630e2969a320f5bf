"""Rounding helpers.

``round_n`` rounds half-up through a decimal: first to 9 places, then to
``n``. Going through 9 places first makes the result independent of the
binary noise in the last bits of a double (``65.3025`` stored as
``65.30249999...`` rounds to ``65.303``), so it agrees with the SQL form
``cast(cast(cast(x as decimal(28,9)) as decimal(18,n)) as double)`` in any
engine. NaN, infinities and numbers beyond the decimal's range stay as they
are: such a double (``10^(18-n)`` and more) has no digit left to round at
``n`` places. ``round_even`` is banker's rounding, the rule of pandas ``round``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_n(c: Column | str, n: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    rounded = c.try_cast("decimal(28,9)").try_cast(f"decimal(18,{n})").cast("double")
    return F.coalesce(rounded, c.cast("double"))


def round_even(c: Column | str, n: int = 0) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.bround(c.cast("double"), n)


def sql_round_n(expr: str, n: int) -> str:
    """The same rounding as SQL text (used by oracle queries and docs)."""
    return f"cast(cast(cast({expr} as decimal(28,9)) as decimal(18,{n})) as double)"
