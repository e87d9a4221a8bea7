"""The operators on the test tables, each with the SQL that must give the same rows."""

from larkspan.plans.catalog import ORACLES, QUERIES
from larkspan.plans import corpus, listings, messages, registry, retrieval, scalars, sources  # noqa: F401  (register)

__all__ = ["ORACLES", "QUERIES"]
