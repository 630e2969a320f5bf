"""Data-quality checks (L1-L8) and the report gate.

Each check has a "failing rows" form (zero rows = pass) and a one-row
summary form. Three ways to the summary of all declared checks:

* ``dq_summary``: every check by itself, over any frames;
* ``dq_summary_fused``: the standard model graph in one scan of each fact table;
* ``WriteChecks``: the jobs' way. The checks of rows are observed metrics of the mart writes, so
  they cost no scan at all; only key uniqueness reads the stored marts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..schemas import EQUIPMENT_STATES
from ..session import observed

# The declared not-null tests per model (36 column tests).
NOT_NULL_TESTS = {
    "stg_event_logs": ["case_id", "operation_name", "event_date", "duration_seconds"],
    "stg_process_norms": ["norm_id", "operation_name", "norm_seconds"],
    "stg_rates": ["tariff_id", "role_name", "hourly_rate"],
    "stg_telemetry": ["ts", "equipment_id", "metric_name", "metric_value", "reading_date"],
    "int_operations_enriched": ["case_id", "operation_name", "event_date", "norm_seconds", "hourly_rate"],
    "int_telemetry_daily_stats": ["reading_date", "equipment_id", "metric_name", "reading_count", "avg_value"],
    "mart_daily_losses": ["event_date", "operation_name", "event_count", "avg_duration_sec",
                          "norm_seconds", "total_loss"],
    "mart_equipment_health": ["reading_date", "equipment_id", "metric_name", "avg_value", "reading_count"],
}
# Declared unique columns and composite keys.
UNIQUE_TESTS = {
    "stg_process_norms": ["norm_id", "operation_name"],
    "stg_rates": ["tariff_id", "role_name"],
}
COMPOSITE_UNIQUE_TESTS = {
    "mart_daily_losses": ["operation_name", "event_date"],
    "mart_equipment_health": ["equipment_id", "metric_name", "reading_date"],
}
MIN_DURATION_EXCLUSIVE, MAX_DURATION_EXCLUSIVE = 0, 86400


# ---------------------------------------------------------------- L1

def null_counts(df: DataFrame, model: str, columns: Sequence[str]) -> DataFrame:
    """L1: null count of every listed column in one pass, one row per column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.selectExpr(f"stack({len(columns)}, {pairs}) as (column_name, null_count)") \
                 .select(F.lit(model).alias("model"), "column_name",
                         F.col("null_count").cast("bigint").alias("null_count"))


# ---------------------------------------------------------------- L2 / L3

def duplicate_keys(df: DataFrame, columns: Sequence[str], sep: str = "::") -> DataFrame:
    """L2/L3 failing rows: key values seen more than once, with their count.

    A composite key is the ``sep``-joined string of its parts (F12), as the
    reference's test expression does.
    """
    key = F.col(columns[0]).cast("string") if len(columns) == 1 else \
        F.concat_ws(sep, *[F.col(c).cast("string") for c in columns])
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def duplicate_summary(df: DataFrame, model: str, columns: Sequence[str]) -> DataFrame:
    """L2/L3 as one row: number of duplicated keys and rows involved."""
    d = duplicate_keys(df, columns)
    return d.agg(
        F.count(F.lit(1)).alias("duplicate_keys"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("duplicate_rows"),
    ).select(F.lit(model).alias("model"), F.lit("::".join(columns)).alias("column_name"),
             "duplicate_keys", "duplicate_rows")


# ---------------------------------------------------------------- L4-L6

def unaccepted_values(df: DataFrame, column: str, accepted: Sequence[str] = EQUIPMENT_STATES) -> DataFrame:
    """L4 failing rows, grouped: value → count, for values outside the list (NULLs are not tested)."""
    return df.filter(~F.col(column).isin(*accepted)).groupBy(F.col(column).alias("value")) \
             .agg(F.count(F.lit(1)).alias("n"))


def negative_losses(mart: DataFrame) -> DataFrame:
    """L5 failing rows."""
    return mart.filter(F.col("total_loss") < 0).select("event_date", "operation_name", "total_loss")


def durations_out_of_range(stg_events: DataFrame) -> DataFrame:
    """L6 failing rows."""
    d = F.col("duration_seconds")
    return stg_events.filter((d <= MIN_DURATION_EXCLUSIVE) | (d >= MAX_DURATION_EXCLUSIVE)) \
                     .select("case_id", "duration_seconds")


# ---------------------------------------------------------------- summary / gate

def _summary_row(check: str, model: str, column: str, failures: DataFrame, count_col: str | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if count_col is None else F.coalesce(F.sum(count_col), F.lit(0))
    return failures.agg(n.cast("bigint").alias("failures")).select(
        F.lit(check).alias("check_name"), F.lit(model).alias("model"),
        F.lit(column).alias("column_name"), "failures")


def dq_summary(models: dict[str, DataFrame]) -> DataFrame:
    """L1-L6 over the given models: one row per declared check instance."""
    parts: list[DataFrame] = []
    for model, cols in NOT_NULL_TESTS.items():
        if model in models:
            parts.append(null_counts(models[model], model, cols).select(
                F.lit("not_null").alias("check_name"), "model", "column_name",
                F.col("null_count").alias("failures")))
    for model, cols in UNIQUE_TESTS.items():
        if model in models:
            for c in cols:
                parts.append(duplicate_summary(models[model], model, [c]).select(
                    F.lit("unique").alias("check_name"), "model", "column_name",
                    F.col("duplicate_keys").alias("failures")))
    for model, cols in COMPOSITE_UNIQUE_TESTS.items():
        if model in models:
            parts.append(duplicate_summary(models[model], model, cols).select(
                F.lit("unique_combination").alias("check_name"), "model", "column_name",
                F.col("duplicate_keys").alias("failures")))
    if "stg_telemetry" in models:
        parts.append(_summary_row("accepted_values", "stg_telemetry", "equipment_state",
                                  unaccepted_values(models["stg_telemetry"], "equipment_state"), "n"))
    if "mart_daily_losses" in models:
        parts.append(_summary_row("no_negative_losses", "mart_daily_losses", "total_loss",
                                  negative_losses(models["mart_daily_losses"])))
    if "stg_event_logs" in models:
        parts.append(_summary_row("duration_in_range", "stg_event_logs", "duration_seconds",
                                  durations_out_of_range(models["stg_event_logs"])))
    return reduce(DataFrame.unionByName, parts)


class QualityGateError(RuntimeError):
    pass


def verdict(summary: DataFrame) -> DataFrame:
    """L7 as one row: whether reports may be written, the checks that failed and their failing rows."""
    bad = F.col("failures") > 0
    return summary.agg((F.count_if(bad) == 0).alias("passed"), F.count_if(bad).alias("failed_checks"),
                       F.coalesce(F.sum(F.when(bad, F.col("failures"))), F.lit(0)).cast("bigint").alias("failures"),
                       F.array_sort(F.collect_list(F.when(bad, F.concat_ws(
                           "", "check_name", F.lit(":"), "model", F.lit("."), "column_name", F.lit("="),
                           F.col("failures").cast("string"))))).alias("failing"))


def gate(found: DataFrame) -> None:
    """Raise before any report is written unless the verdict is that all checks passed."""
    v = found.first()
    if not v.passed:
        raise QualityGateError(f"data-quality checks failed: {', '.join(v.failing)}")


# ---------------------------------------------------------------- checks of rows

Spec = tuple[str, str, str, Column]


def row_checks(model: str, matched: Column | None = None) -> list[Spec]:
    """(check_name, model, column_name, failing-row predicate) of every declared check of a model's rows; with ``matched``
    only rows for which it holds are judged."""
    specs: list[Spec] = [("not_null", model, c, F.col(c).isNull()) for c in NOT_NULL_TESTS[model]]
    d = F.col("duration_seconds")
    if model == "stg_event_logs":
        specs.append(("duration_in_range", model, "duration_seconds", (d <= MIN_DURATION_EXCLUSIVE) | (d >= MAX_DURATION_EXCLUSIVE)))
    if model == "stg_telemetry":
        specs.append(("accepted_values", model, "equipment_state", ~F.col("equipment_state").isin(*EQUIPMENT_STATES)))
    if model == "mart_daily_losses":
        specs.append(("no_negative_losses", model, "total_loss", F.col("total_loss") < 0))
    return specs if matched is None else [(c, m, col, matched & p) for c, m, col, p in specs]


def _unpivot(counts: DataFrame, specs: Sequence[tuple]) -> DataFrame:
    """One row (check_name, model, column_name, failures) for each of the columns ``_c0``, ``_c1``, ..."""
    pairs = ", ".join(f"'{s[0]}', '{s[1]}', '{s[2]}', cast(coalesce(`_c{i}`, 0) as bigint)" for i, s in enumerate(specs))
    return counts.selectExpr(f"stack({len(specs)}, {pairs}) as (check_name, model, column_name, failures)")


def _row_counts(df: DataFrame, specs: list[Spec]) -> DataFrame:
    """Checks of one frame's rows in a single aggregation pass."""
    return _unpivot(df.agg(*[F.count_if(s[3]).alias(f"_c{i}") for i, s in enumerate(specs)]), specs)


def _key(columns: Sequence[str]) -> Column:
    return F.concat_ws("::", *[F.col(c).cast("string") for c in columns])


def _dim_checks(stg_norms: DataFrame, stg_rates: DataFrame) -> list[DataFrame]:
    """Checks of the two dimensions (tiny)."""
    parts = []
    for model, frame in (("stg_process_norms", stg_norms), ("stg_rates", stg_rates)):
        parts.append(_row_counts(frame, row_checks(model)))
        for c in UNIQUE_TESTS[model]:
            parts.append(duplicate_summary(frame, model, [c]).select(
                F.lit("unique").alias("check_name"), "model", "column_name",
                F.col("duplicate_keys").alias("failures")))
    return parts


# ---------------------------------------------------------------- one scan of each fact table

def _two_levels(base: DataFrame, keys: Sequence[str], row_specs: list[Spec], group_specs: list[Spec], model: str,
                aggregates: list[Column], columns: list[Column], matched: Column | None) -> DataFrame:
    """All checks of a fact table and the mart made from it in one plan without branches: rows are counted in the
    mart's groups, groups (projected to the mart's ``columns``) in its keys, keys in one row."""
    exists = F.lit(True) if matched is None else F.col("_exists")
    g = base.groupBy(*keys).agg(
        *aggregates, *[F.count_if(s[3]).alias(f"_r{i}") for i, s in enumerate(row_specs)],
        (F.lit(True) if matched is None else F.bool_or(matched)).alias("_exists"))
    g = g.select(*columns, "_exists", *[f"_r{i}" for i in range(len(row_specs))])
    k = g.groupBy(_key(COMPOSITE_UNIQUE_TESTS[model]).alias("_key")).agg(
        F.count_if(exists).alias("_n"), *[F.sum(f"_r{i}").alias(f"_r{i}") for i in range(len(row_specs))],
        *[F.count_if(exists & s[3]).alias(f"_g{i}") for i, s in enumerate(group_specs)])
    sums = [f"_r{i}" for i in range(len(row_specs))] + [f"_g{i}" for i in range(len(group_specs))]
    total = k.agg(*[F.sum(c).alias(f"_c{i}") for i, c in enumerate(sums)], F.count_if(F.col("_n") > 1).alias(f"_c{len(sums)}"))
    return _unpivot(total, [*row_specs, *group_specs, ("unique_combination", model, "::".join(COMPOSITE_UNIQUE_TESTS[model]))])


def dq_summary_fused(stg_events: DataFrame, dims: DataFrame, stg_norms: DataFrame, stg_rates: DataFrame,
                     stg_telemetry: DataFrame) -> DataFrame:
    """``dq_summary`` of the standard model graph, each fact table scanned once.

    * Events: staged rows are left-joined with the dimensions, so staged, enriched and mart checks come from
      one grouping; a staged row that meets several dimension rows is judged as staged once.
    * Telemetry: staged, stats and health checks from one grouping (the health mart is a projection of the stats).
    """
    from . import equipment as E
    from . import losses as L
    from .joins import sized_broadcast

    nth = F.row_number().over(Window.partitionBy("operation_name").orderBy("role_name", "norm_seconds", "hourly_rate"))
    events = stg_events.join(sized_broadcast(dims.withColumn("_nth", nth)), "operation_name", "left")
    matched = F.col("_nth").isNotNull()
    staged = F.coalesce(F.col("_nth"), F.lit(1)) == 1
    parts = [_two_levels(events, L.MART_KEYS, row_checks("stg_event_logs", staged) + row_checks("int_operations_enriched", matched),
                         row_checks("mart_daily_losses"), "mart_daily_losses", L.mart_aggregates(), L.mart_columns(), matched)]
    parts += _dim_checks(stg_norms, stg_rates)
    # null checks of the stats see the unrounded average, which is null exactly when the rounded one is
    parts.append(_two_levels(stg_telemetry, E.STATS_KEYS, row_checks("stg_telemetry"),
                             row_checks("int_telemetry_daily_stats") + row_checks("mart_equipment_health"), "mart_equipment_health",
                             E.stats_aggregates(), E.health_columns(), None))
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- checks of the mart writes

class WriteChecks:
    """The checks of rows as observed metrics of the jobs that write the marts.

    ``watch`` is given every model's frame while the plans are built (``Models(..., watch=checks.watch)``); when the
    marts are written, the counts of failing rows are there. A task that runs again after a lost executor may count
    its rows twice, which changes the size of a failure but never makes one."""

    def __init__(self):
        self._seen: dict[str, tuple[Observation, list[Spec]]] = {}

    def watch(self, model: str, frame: DataFrame) -> DataFrame:
        specs = row_checks(model)
        observation = Observation(model)
        self._seen[model] = (observation, specs)
        return frame.observe(observation, *[F.count_if(s[3]).alias(f"_c{i}") for i, s in enumerate(specs)])

    def summary(self, stg_norms: DataFrame, stg_rates: DataFrame, mart: DataFrame, health: DataFrame) -> DataFrame:
        """One row per declared check, after the writes: observed counts, dimension checks, key uniqueness of the stored marts."""
        spark = mart.sparkSession
        rows = [(s[0], s[1], s[2], observed(o, f"_c{i}")) for o, specs in self._seen.values() for i, s in enumerate(specs)]
        parts = [spark.createDataFrame(rows, "check_name string, model string, column_name string, failures long"),
                 *_dim_checks(stg_norms, stg_rates)]
        for model, frame in (("mart_daily_losses", mart), ("mart_equipment_health", health)):
            parts.append(duplicate_summary(frame, model, COMPOSITE_UNIQUE_TESTS[model]).select(
                F.lit("unique_combination").alias("check_name"), "model", "column_name", F.col("duplicate_keys").alias("failures")))
        return reduce(DataFrame.unionByName, parts)
