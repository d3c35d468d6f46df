"""Queries by name; importing the modules fills the catalog."""

from . import changes, learners, predictions  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
