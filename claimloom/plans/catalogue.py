"""All queries of the core with their SQL."""

from __future__ import annotations

from . import functions, problems, reconcile, surface

QUERIES: dict = {**problems.QUERIES, **reconcile.QUERIES, **functions.QUERIES, **surface.QUERIES}
SQL: dict = {**reconcile.SQL, **functions.SQL, **surface.SQL}
FLAGSHIP = "relations_by_type"
