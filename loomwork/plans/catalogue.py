"""The registry of the core queries and their SQL."""

from __future__ import annotations

from loomwork.plans import dirty_fields, labour

FLAGSHIP = "salary_summary"
QUERIES: dict = {**dirty_fields.QUERIES, **labour.QUERIES}
SQL: dict[str, str] = {**labour.SQL}
