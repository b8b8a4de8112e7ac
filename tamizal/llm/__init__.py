"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from tamizal.llm.oracles import ORACLES
from tamizal.llm.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
