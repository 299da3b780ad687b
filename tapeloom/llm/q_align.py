"""Query of operator 12."""

from tapeloom.llm import align
from tapeloom.session import spread, table


def op12_align(spark, sf_dir):
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text of documents."""
    import public_tokenizers

    return align.align(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES, ORACLES = {"op12_align": op12_align}, {}
