"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridloom.plans import problems, q_aggregates, q_composites, q_estimates, q_files, q_functions, q_jobs, q_more, q_relational, q_rows
from gridloom.plans.book import Query

BOOKS = (q_functions.book, q_aggregates.book, q_relational.book, q_composites.book, q_more.book, q_rows.book, q_files.book, q_estimates.book, q_jobs.book)
FLAGSHIP = "c_08_cell_year_panel"


def queries() -> dict[str, Query]:
    out = dict(problems.QUERIES)
    for b in BOOKS:
        out |= b.queries
    return out


def oracle_sql() -> dict[str, str]:
    out = dict(problems.ORACLE)
    for b in BOOKS:
        out |= b.sql
    return out
