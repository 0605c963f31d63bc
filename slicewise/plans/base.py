"""Registry of queries, and named SQL views that oracles are put together from."""

from __future__ import annotations

import re

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}
STORED: set[str] = set()  # views that several parts of a statement read, computed once


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame, with its SQL over tables and VIEWS."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def view(name: str, sql: str, stored: bool = False) -> None:
    VIEWS[name] = sql.strip()
    if stored:
        STORED.add(name)


def used(sql: str) -> list[str]:
    """Views that ``sql`` needs, in the order of their definition."""
    need, todo = set(), [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & set(VIEWS) - need:
            need.add(name)
            todo.append(VIEWS[name])
    return [v for v in VIEWS if v in need]


def oracle(sql: str) -> str:
    """``sql`` with the views it uses as common table expressions."""
    sql = sql.strip()
    heads = ", ".join(f"{v} as {'materialized ' if v in STORED else ''}({VIEWS[v]})" for v in used(sql))
    if not heads:
        return sql
    if m := re.match(r"with\s+(recursive\s+)?", sql, re.I):
        return f"with {m[1] or ''}{heads}, {sql[m.end() :]}"
    return f"with {heads} {sql}"


def bucket_sql(text: str, size: int = 1000) -> str:
    return f"cast((('0x' || substr(sha256({text}), 1, 8))::ubigint % {size}) as int)"
