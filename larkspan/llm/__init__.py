"""Operators of a pipeline for training data. Nothing else in the library imports this subpackage."""

from larkspan.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
