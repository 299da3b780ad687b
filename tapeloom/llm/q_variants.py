"""Query of operator 13."""

from tapeloom.llm import variants
from tapeloom.session import spread, table


def op13_variants(spark, sf_dir):
    """word, form, root, n, n_near, form_n of the words of whole documents with at least 6 code points and 5 occurrences."""
    return variants.group(spread(table(spark, sf_dir, "documents")))


QUERIES, ORACLES = {"op13_variants": op13_variants}, {}
