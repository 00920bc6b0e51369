"""The queries over the driver's tables, and DuckDB SQL for the same rows."""

from notewright.plans import files, harmony, library, lookup, meters, nested, repeats, summary, tracks

MODULES = (tracks, harmony, repeats, library, summary, files, meters, nested, lookup)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: s for m in MODULES for name, s in m.ORACLE_SQL.items()}
