"""A corpus pipeline: language ID, near-duplicate removal, PII surrogates, source mixing, packing. Its stages are in riftline.llm.stages."""

from __future__ import annotations

from riftline.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
