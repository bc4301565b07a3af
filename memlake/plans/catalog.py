"""All queries of the library and their SQL oracles."""

from memlake.plans import core, core_sql, memory, memory_sql

QUERIES = {**core.QUERIES, **memory.QUERIES}
ORACLES = {**core_sql.ORACLES, **memory_sql.ORACLES}
