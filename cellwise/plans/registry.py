"""All queries over the reference's operators, by name, and their SQL."""

from __future__ import annotations

from cellwise.plans import compositions, core, relations, reports, statistics

QUERIES = core.QUERIES | statistics.QUERIES | reports.QUERIES | compositions.QUERIES | relations.QUERIES
ORACLES = core.ORACLES | statistics.ORACLES | reports.ORACLES | compositions.ORACLES | relations.ORACLES
