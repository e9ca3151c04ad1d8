"""All queries of the library by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evaluation_jobs, label_jobs, more_jobs, net_jobs, outline_jobs, page_jobs, part_jobs, part_value_jobs, pen_jobs, pin_jobs, scalar_jobs, sink_jobs, style_jobs, summary_jobs, truth_jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _jobs in (scalar_jobs, net_jobs, page_jobs, part_jobs, evaluation_jobs, more_jobs, label_jobs, truth_jobs, outline_jobs, pen_jobs, sink_jobs, style_jobs, pin_jobs, part_value_jobs, summary_jobs):
    QUERIES |= {name: run for name, (run, _) in _jobs.JOBS.items()}
    ORACLES |= {name: sql for name, (_, sql) in _jobs.JOBS.items() if sql}
