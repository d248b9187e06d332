"""The corpus pipeline's contract: its stages, in order, and their run over the documents (see boardlens.llm.pipeline)."""

from boardlens.llm.pipeline import COLUMNS, MASK, ORACLE_SQL, STAGES, drop_contaminated, drop_near_duplicates, drop_toxic, mask_secrets, pack_sequences, run

__all__ = ["COLUMNS", "MASK", "ORACLE_SQL", "STAGES", "drop_contaminated", "drop_near_duplicates", "drop_toxic", "mask_secrets", "pack_sequences", "run"]
