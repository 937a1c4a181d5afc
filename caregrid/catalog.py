"""All queries of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

from .functions.scalars import STOP
from .functions.vocabulary import EXPANSIONS

#: Modules that register queries.
MODULES = ("casemix", "text", "graphs", "records", "evidence", "notes", "scans")


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"caregrid.plans.{name}")
        for k, v in getattr(module, what).items():
            if k in out:
                raise ValueError(f"{k} is registered twice")
            out[k] = v
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    """:STOP and :EXPANSIONS in a query's SQL stand for the list of stop words and for branches of a CASE."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    stop = f"({', '.join(map(quoted, STOP))})"
    expansions = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in EXPANSIONS.items())
    return {k: v.replace(":STOP", stop).replace(":EXPANSIONS", expansions) for k, v in _all("ORACLE").items()}
