"""Query catalogues: operators applied to tables, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from importlib import import_module

CATALOGUES = ("windows", "pairing", "episodes", "cohort", "outcomes", "fitting", "evaluation", "checks", "signals", "assembly", "tables")


def queries() -> dict:
    return {k: f for c in CATALOGUES for k, f in import_module(f"{__name__}.{c}").QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: q for c in CATALOGUES for k, q in import_module(f"{__name__}.{c}").ORACLES.items()}
