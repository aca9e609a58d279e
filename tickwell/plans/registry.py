"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from tickwell.plans import backtests, cross, evidence, extra, learned, published, rolling, studies

_MODULES = (rolling, cross, backtests, extra, evidence, learned, published, studies)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
