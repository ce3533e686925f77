"""Named queries over the tables, and the SQL each is checked against."""

from evidentia.plans import more_queries, pipeline_queries, record_queries, retrieval_queries, scoring_queries, text_queries

_MODULES = (pipeline_queries, text_queries, retrieval_queries, scoring_queries, record_queries, more_queries)
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: text for m in _MODULES for name, text in m.ORACLES.items()}
