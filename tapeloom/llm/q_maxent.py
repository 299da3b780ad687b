"""Query of operator 6."""

from pyspark.sql import functions as F

from tapeloom.llm import maxent
from tapeloom.llm.q_langid import remainder
from tapeloom.session import spread, table


def op6_maxent(spark, sf_dir):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text of documents."""
    docs, learned = spread(table(spark, sf_dir, "documents")), remainder(by=10) != 0
    model = maxent.fit(docs, learned)
    scored = maxent.score(docs, model, learned)
    return scored.select("doc_id", F.coalesce(remainder(by=10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.vocabulary.n).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES, ORACLES = {"op6_maxent": op6_maxent}, {}
