"""Named query plans.  Importing this package registers every query."""

from . import q_analyze, q_models, q_prepare, q_prompts, q_scoring, q_sources  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
