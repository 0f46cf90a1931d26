"""All registered queries of the library, and their SQL."""

from . import flagship, network_queries, ordered_queries, reader_queries, relation_queries, search_queries

_ALL = flagship.QUERIES | ordered_queries.QUERIES | relation_queries.QUERIES | network_queries.QUERIES | reader_queries.QUERIES | search_queries.QUERIES
QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
