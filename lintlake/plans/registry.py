"""All registered queries, and the SQL that checks them."""

from __future__ import annotations

from lintlake.plans import (
    oracle_code,
    oracle_evaluate,
    oracle_findings,
    queries_audit,
    queries_code,
    queries_evaluate,
    queries_findings,
)

QUERIES = {**queries_findings.QUERIES, **queries_code.QUERIES, **queries_evaluate.QUERIES, **queries_audit.QUERIES}
ORACLE = {**oracle_findings.ORACLE, **oracle_code.ORACLE, **oracle_evaluate.ORACLE, **queries_audit.ORACLE}
