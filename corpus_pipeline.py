"""A training corpus from raw documents, in the stages of quern.llm.pipeline."""

from quern.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
