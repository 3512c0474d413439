"""All queries of the engine and their SQL for DuckDB, gathered from the modules that define them."""

from quillgrid.plans import queries_batches, queries_units

QUERIES = queries_units.QUERIES | queries_batches.QUERIES
ORACLE_SQL = queries_units.ORACLE_SQL | queries_batches.ORACLE_SQL
