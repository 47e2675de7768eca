"""Registered queries: each name has a DataFrame plan and, where SQL can say it, an oracle."""

from __future__ import annotations

from . import fit_queries, more_queries, prep_queries, scalar_queries

QUERIES = {**scalar_queries.QUERIES, **fit_queries.QUERIES, **prep_queries.QUERIES, **more_queries.QUERIES}
ORACLE_SQL = {**scalar_queries.ORACLE_SQL, **fit_queries.ORACLE_SQL, **prep_queries.ORACLE_SQL, **more_queries.ORACLE_SQL}
flagship = fit_queries.flagship
