"""Name -> query and name -> DuckDB SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name, sql=None):
    """Decorator: adds a query function (spark, sf_dir) under ``name``, with its SQL if there is any."""

    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add
