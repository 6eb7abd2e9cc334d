"""The corpus pipeline's stages and run, as countloom.llm.pipeline has them."""

from __future__ import annotations

from countloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
