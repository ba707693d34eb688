"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from gatelake.plans import checks, corpus, evaluation, files, graphs, rules

_MODULES = (corpus, graphs, evaluation, files, rules, checks)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
