"""The corpus pipeline: stages over documents, each reading what the one before wrote."""

from quarry.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
