"""All queries of the operators, by name."""

from __future__ import annotations

from ladle.plans import aggregates, analytics, basics, cleaned, entities, stored

QUERIES = {**basics.QUERIES, **aggregates.QUERIES, **entities.QUERIES, **analytics.QUERIES, **stored.QUERIES, **cleaned.QUERIES}
