"""All queries of the engine, and the SQL for them."""

from lorequarry import catalogue, oracle, pieces, queries, stored

QUERIES = queries.QUERIES | catalogue.QUERIES | stored.QUERIES | pieces.QUERIES
ORACLE = oracle.ORACLE | catalogue.ORACLE | stored.ORACLE | pieces.ORACLE

__all__ = ["ORACLE", "QUERIES"]
