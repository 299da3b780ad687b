"""Query of operator 2."""

from pyspark.sql import functions as F

from tapeloom.llm import token_files
from tapeloom.session import scratch, table


def op2_token_files(spark, sf_dir, tokenizer: str | None = None):
    """doc_id, start, n_tokens, ids_crc32 of every whole text of documents, from the files that hold its ids."""
    import public_tokenizers

    files = token_files.write(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, files).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES, ORACLES = {"op2_token_files": op2_token_files}, {}
