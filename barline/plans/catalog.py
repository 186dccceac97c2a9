"""Registered queries and their SQL."""

from __future__ import annotations

from . import advice_queries, audit_queries, backtest_queries, book_queries, brief_queries, composite_queries, factor_queries, indicator_queries, portfolio_queries, record_queries, regime_queries, score_queries, stream_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (indicator_queries, score_queries, backtest_queries, book_queries, composite_queries, factor_queries, record_queries, portfolio_queries, brief_queries, audit_queries, regime_queries, advice_queries, stream_queries):
    _queries, _oracles = _module.build()
    QUERIES |= _queries
    ORACLES |= _oracles
