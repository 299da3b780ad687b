"""Query of operator 4."""

from pyspark.sql import functions as F

from tapeloom.llm import sketch as S
from tapeloom.session import table


def op4_sketch(spark, sf_dir):
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (and n_shingles, edited_contained) of every whole text of documents."""
    rows = S.with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = S.sketch_of(rows, "text", "a").withColumn("b", F.lead("a").over(S.order()))
    rows = S.sketch_of(rows.where("sentinel = 0").withColumn("edited", edited), "edited", "c")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "a", "b", "c")
    a, b, c = map(F.col, "abc")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", S.as_text(a).alias("fingerprint"), S.as_text(c).alias("edited_fingerprint"), S.resemblance(a, c).alias("near_edited"), S.resemblance(a, b).alias("near_next"),
        S.distinct_count(a).alias("n_shingles"), S.containment(a, c).alias("edited_contained"),
    )


QUERIES, ORACLES = {"op4_sketch": op4_sketch}, {}
