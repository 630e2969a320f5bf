"""The model graph (A19, B11): staging → intermediate → marts as lazy DataFrames.

Each property is a DataFrame built from the one before it; nothing runs
until an action, and Catalyst inlines the whole chain into one plan (the
"views" of the reference). Marts are written by ``plans.jobs``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import equipment, losses, staging
from ..sources import adapters, dims


class Models:
    def __init__(self, spark: SparkSession, sf_dir: str, source: str = "events",
                 norms_versioned: DataFrame | None = None, rates_versioned: DataFrame | None = None,
                 event_logs: DataFrame | None = None, telemetry: DataFrame | None = None,
                 watch: Callable[[str, DataFrame], DataFrame] | None = None):
        """``event_logs`` / ``telemetry`` replace the adapters, e.g. with the
        month-partitioned warehouse tables (``jobs.warehouse_models``). ``watch(model, frame)`` may attach
        observed metrics to the frames of the fact models (``quality.WriteChecks``)."""
        self.watch = watch or (lambda model, frame: frame)
        self.spark, self.sf_dir, self.source = spark, sf_dir, source
        self._norms_v, self._rates_v = norms_versioned, rates_versioned
        self._facts, self._tel = event_logs, telemetry

    # sources
    @cached_property
    def event_logs(self) -> DataFrame:
        if self._facts is not None:
            return self._facts
        return adapters.event_logs(self.spark, self.sf_dir, self.source)

    @cached_property
    def telemetry(self) -> DataFrame:
        if self._tel is not None:
            return self._tel
        return adapters.telemetry(self.spark, self.sf_dir)

    @cached_property
    def norms_versioned(self) -> DataFrame:
        return self._norms_v if self._norms_v is not None else dims.norms_versioned(self.spark)

    @cached_property
    def rates_versioned(self) -> DataFrame:
        return self._rates_v if self._rates_v is not None else dims.rates_versioned(self.spark)

    # staging
    @cached_property
    def stg_events(self) -> DataFrame:
        return self.watch("stg_event_logs", staging.stg_event_logs(self.event_logs))

    @cached_property
    def stg_telemetry(self) -> DataFrame:
        return self.watch("stg_telemetry", staging.stg_telemetry(self.telemetry))

    @cached_property
    def stg_norms(self) -> DataFrame:
        return staging.stg_norms(self.norms_versioned)

    @cached_property
    def stg_rates(self) -> DataFrame:
        return staging.stg_rates(self.rates_versioned)

    # intermediate
    @cached_property
    def dims(self) -> DataFrame:
        return losses.dims_joined(self.stg_norms, self.stg_rates)

    @cached_property
    def enriched(self) -> DataFrame:
        return self.watch("int_operations_enriched", losses.ops_enriched(self.stg_events, self.dims))

    @cached_property
    def telemetry_stats(self) -> DataFrame:
        return self.watch("int_telemetry_daily_stats", equipment.telemetry_daily_stats(self.stg_telemetry))

    # marts
    @cached_property
    def mart_daily_losses(self) -> DataFrame:
        return self.watch("mart_daily_losses", losses.mart_daily_losses(self.enriched))

    @cached_property
    def mart_equipment_health(self) -> DataFrame:
        return self.watch("mart_equipment_health", equipment.mart_equipment_health(self.telemetry_stats))

    def dq_summary(self) -> DataFrame:
        """L1-L6 over this graph, one pass per fact source (``quality.dq_summary_fused``)."""
        from ..operators.quality import dq_summary_fused

        return dq_summary_fused(self.stg_events, self.dims, self.stg_norms, self.stg_rates,
                                self.stg_telemetry)

    def quality_models(self) -> dict[str, DataFrame]:
        return {
            "stg_event_logs": self.stg_events,
            "stg_process_norms": self.stg_norms,
            "stg_rates": self.stg_rates,
            "stg_telemetry": self.stg_telemetry,
            "int_operations_enriched": self.enriched,
            "int_telemetry_daily_stats": self.telemetry_stats,
            "mart_daily_losses": self.mart_daily_losses,
            "mart_equipment_health": self.mart_equipment_health,
        }
