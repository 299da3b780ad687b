"""Query of operator 5 and its SQL."""

from pyspark.sql import functions as F

from tapeloom.llm import decontaminate
from tapeloom.session import spread, table


def op5_decontaminate(spark, sf_dir):
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every whole text of documents."""
    found = decontaminate.find(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM sized, unnest(range(1, len(w) - n + 2)) AS r(p)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, greatest(1, len(w) - n + 2))) AS r(p) WHERE len(w) >= n),
occ AS (SELECT doc_id, p, n, item_id FROM grams JOIN wins USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM occ, unnest(range(p, p + n)) AS r(q) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""
QUERIES, ORACLES = {"op5_decontaminate": op5_decontaminate}, {"op5_decontaminate": SQL}
