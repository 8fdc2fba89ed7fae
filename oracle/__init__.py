"""DuckDB statements that state each query a second time, independently of Spark."""

from oracle.statements import oracle_sql

__all__ = ["oracle_sql"]
