"""Named queries over the given tables, each with the SQL it has to equal."""

from __future__ import annotations

from answergauge.plans import gating, measuring, raters, replying, retrieval, running, textual
from answergauge.plans.registry import Query

_MODULES = (raters, gating, retrieval, replying, textual, running, measuring)


def all_queries() -> dict[str, Query]:
    return {name: q for module in _MODULES for name, q in module.QUERIES.items()}
