"""The registered queries and their SQL."""

from folioflow.plans import files, jobs, memory, records, retrieval, streams, text, validation  # noqa: F401
from folioflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
