"""Query of operator 8 and its SQL."""

from pyspark.sql import functions as F

from tapeloom.llm import warc
from tapeloom.session import scratch, table


def op8_warc(spark, sf_dir):
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archives.

    A response's digest is computed from the payload as it is read; a revisit's is the stated one.
    """
    files = warc.write(warc.chunks(warc.decide(table(spark, sf_dir, "pages"))), scratch(spark, "warc"))
    rows = warc.read(spark, files, payloads=False).where("last")
    return rows.select("page_id", "payload_bytes", F.when(F.col("record_type") == "response", F.col("digest")).otherwise(F.col("stated_digest")).alias("payload_digest"), "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) AS k, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND k > 1 THEN first_id END AS refers_to
FROM f
"""
QUERIES, ORACLES = {"op8_warc": op8_warc}, {"op8_warc": SQL}
