"""All queries of the reference's operators, with the SQL of those that SQL can express."""
from winnowry.plans import corpus_queries, fixture_queries, golden_queries, stage_queries, stream_queries, table_queries

QUERIES = corpus_queries.QUERIES | fixture_queries.QUERIES | stage_queries.QUERIES | golden_queries.QUERIES | stream_queries.QUERIES | table_queries.QUERIES
ORACLES = corpus_queries.ORACLES | fixture_queries.ORACLES | stage_queries.ORACLES | golden_queries.ORACLES | stream_queries.ORACLES | table_queries.ORACLES
