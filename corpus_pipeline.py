"""The corpus pipeline: STAGES of (name, function), run(spark, sf_dir) and its SQL; the stages themselves are in tracewright.llm.stages."""

from tracewright.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
