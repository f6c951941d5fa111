"""All queries of the library by name, each with its SQL twin where SQL can state it."""

from __future__ import annotations

from . import files, incremental, relational, textual

QUERIES: dict = {**relational.CATALOGUE.queries, **textual.CATALOGUE.queries, **files.CATALOGUE.queries, **incremental.CATALOGUE.queries}
ORACLE_SQL: dict = {**relational.CATALOGUE.sql, **textual.CATALOGUE.sql, **files.CATALOGUE.sql, **incremental.CATALOGUE.sql}
