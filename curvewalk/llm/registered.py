"""All queries of this package and the pipeline's, with their SQL."""

from __future__ import annotations

import corpus_pipeline
from curvewalk.llm import queries

QUERIES = queries.QUERIES | {"pipeline": corpus_pipeline.run}
ORACLES = queries.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
