"""Queries by name and their SQL oracles."""

from __future__ import annotations

from winnower.operators import admin, agents, compress, content, counting, devtools, guards, langid, ledger, oracles, privacy, retrieval, sessions, structured, summarize
from winnower.sources import stores
from winnower.streaming import twins

_MODULES = [counting, langid, compress, content, guards, retrieval, ledger, sessions, structured, summarize, privacy, devtools, stores, agents, twins, admin]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
ORACLES |= oracles.ORACLES
