"""Query of operator 1."""

from pyspark.sql import functions as F

from tapeloom.llm import byte_bpe
from tapeloom.session import spread, table


def op1_byte_bpe(spark, sf_dir, vocabulary: str | None = None):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text of documents."""
    import public_tokenizers

    rows = byte_bpe.encode(spread(table(spark, sf_dir, "documents")), vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), offsets=False, decode=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES, ORACLES = {"op1_byte_bpe": op1_byte_bpe}, {}
