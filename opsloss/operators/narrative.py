"""Report texts as string columns.

The remote text generation and chat delivery are not built; what is built
is the text each of them is fed with, for every anomaly and every report,
as ordinary columns (F17): the columns of ``reports.top_anomalies`` in their
order, each as ``column=value``. The number formats are fixed: ``.0f``
seconds, ``,.2f`` money, ``.1f`` minutes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formatting as fmt


def _plain(column: str) -> Column:
    return F.col(column).cast("string")


# The format of each column of top_anomalies that a text may hold.
FORMATS: dict[str, Callable[[str], Column]] = {
    "operation_name": _plain,
    "avg_duration_sec": fmt.whole,
    "norm_seconds": _plain,
    "delta_sec": fmt.whole,
    "hourly_rate": fmt.money,
    "total_loss": fmt.money,
    "event_count": _plain,
}


def facts(columns: Iterable[str]) -> list[Column]:
    """``column=value`` for each of the columns, in the order given."""
    return [F.concat(F.lit(f"{c}="), FORMATS[c](c)) for c in columns]


def prompt_text() -> Column:
    """One anomaly row as text: all its facts, then its two durations in minutes."""
    minutes = [F.concat(F.lit(f"{label}="), fmt.one_decimal(F.col(c).cast("double") / F.lit(60.0)))
               for label, c in (("avg_duration_min", "avg_duration_sec"), ("norm_min", "norm_seconds"))]
    return F.concat_ws("; ", *facts(FORMATS), *minutes)


def fallback_text() -> Column:
    """Deterministic text used when no generated hypotheses are available."""
    return F.concat_ws("; ", *facts(["operation_name", "delta_sec"]), F.lit("cause=unknown"))


def caption_text(total_loss: Column | str = "total_loss") -> Column:
    """Delivery caption with the report's total loss."""
    return F.concat(F.lit("total_loss="), fmt.money(total_loss))


def anomaly_prompts(anomalies: DataFrame, key: str = "report_date") -> DataFrame:
    return anomalies.select(key, "rank", "operation_name", prompt_text().alias("prompt_text"))


def anomaly_fallbacks(anomalies: DataFrame, key: str = "report_date") -> DataFrame:
    return anomalies.select(key, "rank", "operation_name", fallback_text().alias("fallback_text"))


def report_captions(totals: DataFrame, key: str = "report_date") -> DataFrame:
    return totals.select(key, caption_text().alias("caption"))
