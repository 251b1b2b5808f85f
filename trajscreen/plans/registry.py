"""Queries of the screening operators by name, with the SQL each must equal."""

from __future__ import annotations

from trajscreen.plans import evaluation, injected, screening

QUERIES = screening.QUERIES | evaluation.QUERIES | injected.QUERIES
ORACLE_SQL = screening.ORACLE_SQL | evaluation.ORACLE_SQL | injected.ORACLE_SQL
flagship = screening.flagship
