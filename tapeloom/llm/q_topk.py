"""Query of operator 11, with its SQL."""

from tapeloom.llm import topk
from tapeloom.session import table


def op11_topk(spark, sf_dir):
    """query_id, rank, vec_id, score: the five best vectors for every vec_id divisible by 50, by inner products of floor(256 * x)."""
    return topk.neighbours(table(spark, sf_dir, "embeddings"))


SQL = """
WITH own AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM own q JOIN own c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

QUERIES, ORACLES = {"op11_topk": op11_topk}, {"op11_topk": SQL}
