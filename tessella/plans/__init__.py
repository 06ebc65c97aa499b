"""Queries by name, each with its operator applied to the test tables and its check in SQL."""

from tessella.plans import annotation, audits, checks, content, exports, issues, store, workflow
from tessella.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "annotation", "audits", "checks", "content", "exports", "issues", "store", "workflow"]
