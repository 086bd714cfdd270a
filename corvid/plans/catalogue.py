"""Every query of the engine by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from corvid.plans import extras, lexical, measures, retrieval, runs, texts, vectors

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (lexical, vectors, texts, runs, extras, retrieval, measures):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
