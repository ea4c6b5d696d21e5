"""A corpus pipeline of five stages; they are in fleetmetrics.llm.pipeline."""

from fleetmetrics.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
