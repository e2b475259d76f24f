"""Registered queries, the operators each covers, and their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: name -> (query, ids of the operators it covers, SQL or None)
REGISTRY: dict[str, tuple[Callable, tuple[str, ...], str | None]] = {}
MODULES = ("votes", "consensus", "labels", "overlap", "spatial", "text", "stats", "vectors", "checks", "greedy", "composites", "files", "scoring", "streams")


def query(ops: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def put(f):
        if f.__name__ in REGISTRY:
            raise ValueError(f"query {f.__name__} exists")
        REGISTRY[f.__name__] = (f, tuple(ops.split()), sql)
        return f

    return put


def load() -> dict:
    for m in MODULES:
        importlib.import_module(f"tallyframe.plans.{m}")
    return REGISTRY


def queries() -> dict:
    return {name: f for name, (f, _, _) in load().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, _, sql) in load().items() if sql}


def coverage() -> str:
    """Markdown table of operator ids and the queries that exercise them."""
    by: dict[str, list[str]] = {}
    for name, (_, ops, sql) in load().items():
        for o in ops:
            by.setdefault(o, []).append(f"`{name}`" + ("" if sql else " (rows)"))
    split = lambda o: (o.rstrip("0123456789"), int(o[len(o.rstrip("0123456789")) :]))
    return "\n".join(["| Operator | Queries |", "|---|---|", *(f"| {o} | {', '.join(by[o])} |" for o in sorted(by, key=split))])
