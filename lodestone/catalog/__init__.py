"""Queries over the driver tables, each with the SQL that must give the same rows."""

from . import corpus, evaluation, indexing, lexical, reading, resampling, retrieval  # noqa: F401
from .common import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
