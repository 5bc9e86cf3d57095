"""All queries of the library's own operators, with the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from feedloom.plans import delivery_queries, feedback_queries, page_queries, ranking_queries, rules_queries, state_queries, text_queries

_MODULES = (text_queries, ranking_queries, feedback_queries, state_queries, rules_queries, page_queries, delivery_queries)
QUERIES = reduce(lambda a, m: a | m.QUERIES, _MODULES, {})
ORACLE_SQL = reduce(lambda a, m: a | m.ORACLE_SQL, _MODULES, {})
