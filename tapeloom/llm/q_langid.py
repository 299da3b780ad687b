"""Query of operator 10."""

from pyspark.sql import functions as F

from tapeloom.llm import langid
from tapeloom.session import spread, table


def remainder(id_col: str = "doc_id", by: int = 5):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def learned(docs):
    """Models from the rows whose crc32(doc_id) mod 5 is not 0."""
    return langid.fit(docs.where(remainder() != 0))


def op10_langid(spark, sf_dir):
    """doc_id, held_out, lang_pred, score (and cross_entropy, rejected) of every whole text of documents."""
    docs = spread(table(spark, sf_dir, "documents"))
    found = langid.predict(docs, learned(docs))
    return found.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


QUERIES, ORACLES = {"op10_langid": op10_langid}, {}
