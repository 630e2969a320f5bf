"""Column-level helpers: rounding, dates, formatting, loss expressions."""

from .rounding import round_even, round_n  # noqa: F401
