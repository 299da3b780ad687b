"""Query of operator 9."""

from tapeloom.llm import simhash
from tapeloom.session import spread, table


def op9_simhash(spark, sf_dir):
    """doc_id, fingerprint, component_id of every whole text of documents."""
    found = simhash.components(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", simhash.hex_print("fp").alias("fingerprint"), "component_id")


QUERIES, ORACLES = {"op9_simhash": op9_simhash}, {}
