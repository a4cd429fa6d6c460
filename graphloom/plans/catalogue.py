"""All queries of the library but for the corpus operators."""

from __future__ import annotations

from . import eval_queries, graph_queries, graph_sql, model_queries, model_sql, train_queries

QUERIES = graph_queries.QUERIES | train_queries.QUERIES | model_queries.QUERIES | eval_queries.QUERIES
SQL = graph_sql.SQL | train_queries.SQL | model_sql.SQL | eval_queries.SQL
