"""Operators for training-data pipelines. Nothing else in the library imports this subpackage.

``queries()`` and ``oracle_sql()`` collect what each operator module registers.
"""

from __future__ import annotations

import importlib

MODULES = (
    "decontaminate",
    "html_text",
    "chat",
    "media",
    "mixing",
    "packing",
    "periodic",
    "pii",
    "quality",
    "resample",
    "simhash",
    "suffix",
    "toxicity",
)


def _modules():
    return [importlib.import_module(f"{__name__}.{m}") for m in MODULES]


def queries() -> dict:
    return {name: query for m in _modules() for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _modules() for name, sql in m.ORACLE_SQL.items()}
