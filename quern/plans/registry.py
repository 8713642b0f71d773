"""All registered queries of the retrieval engine, and the SQL of those that SQL can express."""

from . import catalogue, sql, trials

QUERIES = catalogue.QUERIES | trials.QUERIES
SQL = sql.SQL | trials.SQL
