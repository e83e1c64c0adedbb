"""Every registered query of the engine and its DuckDB oracle."""

from lodestream.plans import adaptive, analytics, dedup, ingest, memory, planning, relational, retrieval, vectors

_MODULES = [retrieval, memory, analytics, vectors, dedup, relational, planning, adaptive, ingest]
_ALL = {name: pair for module in _MODULES for name, pair in module.QUERIES.items()}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
