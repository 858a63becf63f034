"""Every operator as a query over the input tables, with SQL that gives the same rows."""

from evigrid.queries import canonical, decisions, exports, graphs, payloads, plugins, reads, records, scores, streams, text  # noqa: F401
from evigrid.queries.registry import oracle_sql, queries  # noqa: F401
