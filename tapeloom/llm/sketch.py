"""Bottom-k sketches of word shingles, in DataFrame functions only.

A text's words are what stands between white space, A-Z in lower case; its shingles are runs of five words, or the
whole sequence of fewer. A sketch is the ascending array of the k smallest distinct hashes of the shingles, hashes being
the upper 48 bits of 64. Sketches of parts merge into the sketch of the whole. Two sketches estimate the resemblance and
the containment of their shingle sets, one the number of its distinct shingles; with fewer than k shingles these are
exact.

Null and empty texts have no words and an empty sketch, written as the empty string. Two empty sketches resemble each
other fully, an empty one and another not at all. Repeated rows give a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import ascii_lower, pick

K, SHINGLE, BITS = 128, 5, 48
_MOST = 1 << BITS


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def shingle_hashes(own: Column, shingle: int = SHINGLE) -> Column:
    """The hashes of an array of words' shingles, repeats included."""
    at = lambda i, j: F.get(own, i + j)
    full = F.transform(F.sequence(F.lit(0), F.size(own) - shingle), lambda i: F.shiftrightunsigned(F.xxhash64(*(at(i, j) for j in range(shingle))), 64 - BITS))
    return F.when(F.size(own) >= shingle, full).when(F.size(own) > 0, F.array(F.shiftrightunsigned(F.xxhash64(*(F.coalesce(F.get(own, F.lit(j)), F.lit("\n")) for j in range(shingle))), 64 - BITS))).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct values of an array, ascending."""
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The sketch of a text column, as one expression; where both words and hashes are costly, sketch_of is cheaper."""
    return bottom(shingle_hashes(words(text), shingle), k)


def sketch_of(df: DataFrame, text_col: str, name: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """df with the sketch of text_col added as name. The words are made once a row: the lambdas refer to a column."""
    rows = df.withColumn("_words", words(F.col(text_col)))
    return rows.withColumn(name, bottom(shingle_hashes(F.col("_words"), shingle), k)).drop("_words")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketches' sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge_all(df: DataFrame, by: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group of by. The k smallest of all members' hashes: ranked by task first, so that a large group moves k hashes a task."""
    rows = df.select(*by, F.explode(sketch_col).alias("h")).groupBy(*by, "h").agg(F.lit(1).alias("one"))
    part = rows.withColumn("part", F.pmod("h", F.lit(64)))
    few = part.withColumn("r", F.row_number().over(Window.partitionBy(*by, "part").orderBy("h"))).where(F.col("r") <= k)
    return few.groupBy(*by).agg(bottom(F.collect_list("h"), k).alias("sketch"))


def distinct_count(a: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((F.lit(k) - 1) * F.lit(float(_MOST)) / F.element_at(a, -1))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of the union's shingles that both sets have: that of the union's k smallest."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has: the shared part of the union's distinct shingles over a's."""
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as 12 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")), "")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, text and next_text, the text of the row that follows in descending order of id, the last one's being the first's; further columns bucket and sentinel.

    Null ids come last, equal ids by text. The ids are dealt into buckets at values that are ids themselves, so each
    bucket's first row is known beforehand; copies of it, the sentinels, close the bucket before. One shuffle then has
    all that a window needs. Sentinels stay in the result for further windows; drop them with sentinel = 0.
    """
    spark = df.sparkSession
    rows = pick(df, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"))
    n = buckets or min(4096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(rows.select("key").approxQuantile("key", [i / n for i in range(1, n + 1)], 0.25 / n))) if n > 1 else []
    top = rows.agg(F.max("key")).first()[0]
    edges = sorted({int(c) for c in cuts if c < top} | {top}) if top is not None else []
    exact = {r.key for r in rows.where(F.col("key").isin(edges)).select("key").distinct().collect()} if edges else set()
    edges = [c for c in edges if c in exact]  # quantiles pass through doubles, which large ids may not survive
    width = max(1, int(len(edges) ** 0.5))
    fine = [edges[i : i + width] for i in range(0, len(edges), width)]
    key = F.col("key")
    below = lambda a: F.size(F.filter(a, lambda c: c < key))
    if len(edges) > 1:
        coarse = below(F.array(*(F.lit(f[-1]) for f in fine)))
        bucket = coarse * width + below(F.get(F.array(*(F.array(*map(F.lit, f)) for f in fine)), coarse))
    else:
        bucket = F.lit(0)
    own = rows.withColumn("bucket", bucket.cast("int"))
    head = F.col("key").isin(edges) if edges else F.lit(False)
    places = F.when(head, F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("s")), F.struct(F.pmod(F.col("bucket") + 1, F.lit(max(1, len(edges)))).alias("b"), F.lit(1).alias("s")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("s"))))
    dealt = own.withColumn("_p", F.explode(places)).select("doc_id", "text", "key", F.col("_p.b").alias("bucket"), F.col("_p.s").alias("sentinel"))
    return dealt.withColumn("next_text", F.lead("text").over(order()))


def order():
    """The window of with_next."""
    return Window.partitionBy("bucket").orderBy("sentinel", F.col("key").desc(), F.col("doc_id").isNull(), "text")


