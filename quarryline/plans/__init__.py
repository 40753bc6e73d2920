"""Named queries and their SQL. The SQL is written from the rules of the marts, not from the DataFrame code."""

from __future__ import annotations

from . import answers, datasets, market, scores, tables, texts
from .market import market_daily

QUERIES = market.QUERIES | datasets.QUERIES | texts.QUERIES | scores.QUERIES | tables.QUERIES | answers.QUERIES
SQL = market.SQL | datasets.SQL | texts.SQL | scores.SQL | tables.SQL | answers.SQL
__all__ = ["QUERIES", "SQL", "market_daily"]
