"""Every registered query of the engine with its DuckDB SQL."""

from __future__ import annotations

from panelforge.plans import audit_queries, backtest_queries, calendar_queries, chart_queries, evaluation_queries, extract_queries, factor_queries, harvest_queries, judge_queries, news_queries, operations_queries, paired_queries, report_queries, rule_queries, selection_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (factor_queries, selection_queries, evaluation_queries, operations_queries, rule_queries, report_queries, backtest_queries, chart_queries, audit_queries, paired_queries, harvest_queries, extract_queries, news_queries, calendar_queries, judge_queries):
    QUERIES |= module.register.queries
    ORACLES |= module.register.oracles
