"""All queries and oracles of the engine."""

from __future__ import annotations

import functools

from ..shipping import ship
from . import analysis, base, bundles, checks, comparison, files, training  # noqa: F401


def _shipped(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        return query(ship(spark), sf_dir)

    return run


def queries() -> dict:
    return {name: _shipped(f) for name, f in base.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: base.oracle(sql) for name, sql in base.ORACLES.items()}
