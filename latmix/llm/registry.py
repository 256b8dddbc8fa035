"""The queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline

from . import ann, bpe, embed_dedup, fim, jaccard, lexical, mixing, pii, quality, rules, secrets, suffix, toxicity

MODULES = (bpe, secrets, toxicity, embed_dedup, ann, quality, jaccard, pii, suffix, mixing, fim, lexical, rules)


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {k: v for m in MODULES for k, v in m.ORACLE.items()} | own
