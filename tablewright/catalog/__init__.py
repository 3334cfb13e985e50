"""Queries over the given tables: every operator on real columns, with the same result written in SQL."""

from __future__ import annotations

from tablewright.catalog.registry import ORACLE, QUERIES

from tablewright.catalog import tables, profiling, features, scoring, models, search, logs  # noqa: E402,F401

__all__ = ["ORACLE", "QUERIES"]
