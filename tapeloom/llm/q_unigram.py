"""Query of operator 7."""

from tapeloom.llm import unigram
from tapeloom.session import spread, table


def op7_token_counts(spark, sf_dir, model: str | None = None):
    """doc_id, n_tokens, score of every whole text of documents."""
    import public_tokenizers

    return unigram.count(spread(table(spark, sf_dir, "documents")), model or public_tokenizers.path("piece_bpe_32k.model"), split=False)


QUERIES, ORACLES = {"op7_token_counts": op7_token_counts}, {}
