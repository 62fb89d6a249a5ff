"""What ``__spark_entry__`` adds: the queries of this subpackage, the pipeline included, and their SQL."""

import corpus_pipeline
from tidemark.llm import queries, sql

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLE_SQL = {**sql.ORACLE_SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
