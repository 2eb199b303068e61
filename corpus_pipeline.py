"""The corpus pipeline under the name that the driver imports; its stages are in tallyforge/llm/pipeline.py."""

from tallyforge.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
