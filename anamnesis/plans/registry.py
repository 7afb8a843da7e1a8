"""All queries of the core, with the SQL that checks them."""

from __future__ import annotations

from anamnesis.plans import dealt, domain, io, more, pipelines, relational, retrieval, scalar, windows

MODULES = [scalar, relational, windows, retrieval, domain, io, more, pipelines, dealt]


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
