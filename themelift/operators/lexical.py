"""Text-relevance candidates: BM25 over word tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themelift.functions.text import strip
from themelift.functions.vectors import DIGITS, to_distance
from themelift.operators.positions import topk_per
from themelift.schemas import KEYWORD_KEY
from themelift.sizing import BROADCAST_BYTES, SALTS, Size, lookup_join, measure

# The usual BM25 constants.
K1 = 1.2
B = 0.75
TOP_K = 100
# Of the weight and the mean length that are sent with each term.
WEIGHT_BYTES = 32


def tokens(c):
    """Lower-case words of a text."""
    return F.filter(F.split(F.lower(strip(c)), r"(?U)\s+"), lambda t: F.length(t) > 0)


def lexical_topk(
    keywords: DataFrame,
    log: DataFrame,
    k: int = TOP_K,
    limit: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """The ``k`` log rows with the highest BM25 score per keyword; ties go to the lower id.

    ``similarity`` is the score over the keyword's best score, ``distance`` is 1 - similarity.
    Token weights travel with the keyword side, so that the log is joined once, on the tokens the
    keywords use; the sums are keyed by (keyword, id), which spreads hot tokens evenly. Distinct
    keyword texts are scored, and only their best rows are handed to the themes that use them.
    """
    text = ["market", "keyword"]
    terms = keywords.select(*text).distinct().select(
        *text, F.explode(F.array_distinct(tokens(F.col("keyword")))).alias("token")
    )
    size = measure(terms)
    fits = Size(size.rows, size.bytes + WEIGHT_BYTES * size.rows).fits(limit)  # with their weights
    words = log.select("market", "id", tokens(F.col("normalized_query")).alias("words")).withColumn(
        "dl", F.size("words")
    )
    # One row per market: the aggregate is as small as the market dimension.
    totals = words.groupBy("market").agg(
        F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("avg_dl")
    )
    tf = F.size(F.filter("words", lambda w: w == F.col("token")))
    postings = words.withColumn("token", F.explode(F.array_distinct("words")))
    if fits:
        wanted = terms.select("market", "token").distinct()
        postings = postings.join(F.broadcast(wanted), ["market", "token"], "left_semi")
    frequency = postings.groupBy("market", "token").agg(F.count(F.lit(1)).alias("df"))
    postings = postings.select("market", "id", "dl", "token", tf.alias("tf"))
    weighted = (
        terms.join(frequency, ["market", "token"])
        .join(totals, "market")
        .withColumn(
            "idf",
            F.log(
                F.lit(1.0)
                + (F.col("docs") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))
            ),
        )
        .select(*text, "token", "idf", "avg_dl")
    )
    if fits:
        pairs = postings.join(F.broadcast(weighted), ["market", "token"])
    else:
        salted = weighted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        spread = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
        pairs = postings.withColumn("_salt", spread).join(salted, ["market", "token", "_salt"])
    length = F.lit(1.0 - B) + F.lit(B) * F.col("dl") / F.col("avg_dl")
    part = F.col("idf") * F.col("tf") * F.lit(K1 + 1.0) / (F.col("tf") + F.lit(K1) * length)
    scored = pairs.groupBy(*text, "id").agg(F.round(F.sum(part), DIGITS).alias("score"))
    top = topk_per(scored, text, [F.col("score").desc(), F.col("id")], k)
    best = F.max("score").over(Window.partitionBy(*text))
    similarity = F.round(F.col("score") / best, DIGITS)
    near = top.withColumn("similarity", similarity).withColumn(
        "distance", to_distance(F.col("similarity"))
    )
    themed = lookup_join(near, keywords.select(*KEYWORD_KEY), text, limit=limit, salts=salts)
    return themed.select(*KEYWORD_KEY, "id", "score", "similarity", "distance")
