"""The queries of this subpackage and their SQL."""

import corpus_pipeline
from tapeloom.llm import q_align, q_byte_bpe, q_decontaminate, q_langid, q_maxent, q_secrets, q_simhash, q_sketch, q_token_files, q_topk, q_unigram, q_variants, q_warc

_MODULES = (q_byte_bpe, q_token_files, q_secrets, q_sketch, q_decontaminate, q_maxent, q_unigram, q_warc, q_simhash, q_langid, q_topk, q_align, q_variants)


def queries() -> dict:
    return {**{k: f for m in _MODULES for k, f in m.QUERIES.items()}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    own = {k: sql for m in _MODULES for k, sql in m.ORACLES.items()}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
