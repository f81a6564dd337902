"""Import every plan module so that the registry is complete."""

from __future__ import annotations

from . import comparison, corpus, evaluation, features, io, monitoring, scorers, text  # noqa: F401
from .registry import HEADLINE, ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE", "HEADLINE"]
