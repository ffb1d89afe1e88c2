"""Query name -> (spark, sf_dir) callable, and query name -> oracle SQL, for the reference's operators."""

from __future__ import annotations

from pathwise.plans import complete, composites, labels, live, packed, relational, reviewed, scalars, sequence, service, weekly

MODULES = (sequence, relational, labels, scalars, weekly, service, composites, reviewed, live, packed, complete)
QUERIES: dict = {name: query for m in MODULES for name, query in m.plans.queries.items()}
ORACLES: dict = {name: sql for m in MODULES for name, sql in m.plans.oracles.items()}
