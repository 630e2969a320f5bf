"""opsloss: operations labour-cost-loss analytics on Spark DataFrames.

Every operator is a function from DataFrames to DataFrames. Nothing is
collected to the driver on the core path; "now" is always an argument.

Entry points:

* ``opsloss.plans.models.Models`` - the model graph (staging → enrichment → marts)
  over the adapters or over stored warehouse tables;
* ``opsloss.operators.reports.build_daily_report`` / ``build_weekly_report``;
* ``opsloss.operators.calibration`` - norm recommendations;
* ``opsloss.operators.quality.dq_summary_fused`` + ``gate`` - data-quality checks;
* ``opsloss.sources.ingest`` / ``opsloss.streaming.ingest`` - request-batch ingest;
* ``opsloss.streaming.aggregates`` - streaming health and loss marts;
* ``opsloss.plans.jobs`` and ``python -m opsloss`` - the scheduled jobs;
* ``opsloss.plans.catalog`` - the registered queries and their SQL oracles.
"""

__version__ = "0.1.0"
