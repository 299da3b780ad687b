"""Query of operator 3."""

from pyspark.sql import functions as F

from tapeloom.llm import secrets
from tapeloom.session import spread, table


def op3_secrets(spark, sf_dir):
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (and n_random) of every whole text of documents."""
    found = secrets.find(spread(table(spark, sf_dir, "documents")))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secrets.joined(F.filter("spans", lambda s: s["kind"] != "random"))
    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(base, 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


QUERIES, ORACLES = {"op3_secrets": op3_secrets}, {}
