"""Corpus preparation: the stages are in polyglint.llm.pipeline."""

from polyglint.llm.pipeline import ORACLE_SQL, STAGES, dedup_lines, drop_contaminated, drop_near_duplicates, drop_toxic, encode, run

__all__ = ["ORACLE_SQL", "STAGES", "dedup_lines", "drop_contaminated", "drop_near_duplicates", "drop_toxic", "encode", "run"]
