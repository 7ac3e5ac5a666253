"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from quarrymill.plans import campaigns, files, lineage, nested, reports, studies, writing

QUERIES: dict = lineage.QUERIES | studies.QUERIES | reports.QUERIES | writing.QUERIES | campaigns.QUERIES | nested.QUERIES | files.QUERIES
ORACLE_SQL: dict[str, str] = lineage.ORACLE_SQL | studies.ORACLE_SQL | reports.ORACLE_SQL | writing.ORACLE_SQL | campaigns.ORACLE_SQL | nested.ORACLE_SQL | files.ORACLE_SQL
