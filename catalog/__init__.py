"""Registered queries over the driver tables, each with its SQL counterpart."""

from catalog.base import ORACLES, QUERIES
from catalog import cleaning, jobs, leaderboard, metrics, plans, shaping, texts  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
