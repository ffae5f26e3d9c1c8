"""Queries of the subpackage and of corpus_pipeline.py, and the SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from texmill.llm import queries as q

QUERIES = {name: f for name, f in sorted(vars(q).items()) if name.startswith("op")} | {"pipeline": corpus_pipeline.run}
ORACLES = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
