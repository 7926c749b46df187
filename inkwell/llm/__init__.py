"""Training-data pipeline operators. `entries()` lists their queries and SQL; nothing outside this package imports it."""

from __future__ import annotations

import importlib

#: Modules that define QUERIES and ORACLES.
MODULES = ("chat_format", "ppm_score", "source_mix", "token_planes", "quality", "toxicity", "simhash", "language_id", "decontaminate", "media_sequences", "shard_balance", "vector_codes", "periodic_runs")


def entries() -> tuple[dict, dict]:
    """(queries, SQL) of all operators here."""
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        sql |= module.ORACLES
    return queries, sql
