"""All queries of the subpackage and the pipeline, for the driver's entry module."""

from __future__ import annotations

from importlib import import_module

MODULES = ["mixing", "quality", "sharding", "byte_bpe", "token_counts", "simhash", "toxicity", "embeddings", "substrings", "lines", "chat", "conversations", "alignment"]


def load():
    for name in MODULES:
        import_module(f"marketlens.llm.{name}")
    from marketlens.llm.common import ORACLES, QUERIES

    pipeline = import_module("corpus_pipeline")
    queries, oracles = dict(QUERIES) | {"pipeline": pipeline.run}, dict(ORACLES)
    if pipeline.ORACLE_SQL:
        oracles["pipeline"] = pipeline.ORACLE_SQL
    return queries, oracles
