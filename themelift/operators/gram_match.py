"""Nearest log rows of a keyword by cosine of character-gram counts.

A lexical stand-in for a sentence encoder: a text is the vector of counts of the 3-grams of its
padded clean form. It finds typos and contained phrases, not synonyms.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themelift.functions.grams import GRAM, explode_grams, gram_list, numbers_at, padded, text_points
from themelift.functions.vectors import DIGITS
from themelift.operators.keywords import gram_counts, prepare_keywords
from themelift.operators.positions import topk_per
from themelift.schemas import KEYWORD_KEY, METRICS
from themelift.sizing import BROADCAST_BYTES, SALTS, lookup_join, measure, stage

# The task code below travels with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP_K = 100
# Distinct keyword texts that a scan compares with each log row; more are found by a join.
SCAN_TEXTS = 4096
# Inner products of one block of the scan.
BLOCK = 1_000_000
# A short hash of a gram's number, and an odd factor that makes it.
HASH_BITS = 24
HASH_FACTOR = -7046029254386353131
# Grams per keyword whose absence is tested before the exact comparison.
RARE = 4
# Width of a size class of query norms.
CLASS_RATIO = 1.25
SLACK = 1e-8


@F.arrow_udf(T.StructType().add("total", "integer").add("top", "integer"))
def gram_runs(texts: pa.Array) -> pa.Array:
    """Struct of a text's grams: ``total`` is the sum of squared gram counts, ``top`` the highest
    count."""
    points, row, left = text_points(pc.fill_null(texts, ""))
    at, number = numbers_at(points, left, GRAM)
    row = row[at]
    total, top = np.bincount(row, minlength=len(texts)), np.bincount(row, minlength=len(texts)).clip(0, 1)
    # Texts with two grams of one short hash may have one gram twice.
    key = np.sort(row << HASH_BITS | (number * HASH_FACTOR >> 64 - HASH_BITS) & ((1 << HASH_BITS) - 1))
    again = np.unique(key[1:][key[1:] == key[:-1]] >> HASH_BITS)
    some = np.isin(row, again)
    row, number = row[some], number[some]
    order = np.lexsort((number, row))
    row, number = row[order], number[order]
    begins = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (number[1:] != number[:-1]))[: len(row)])
    n = np.diff(np.append(begins, len(row)))
    total[again] = 0
    np.add.at(total, row[begins], n * n)
    np.maximum.at(top, row[begins], n)
    columns = [pa.array(c.astype(np.int32)) for c in (total, top)]
    return pa.StructArray.from_arrays(columns, ["total", "top"], mask=pc.is_null(texts))


def with_gram_text(log: DataFrame) -> DataFrame:
    """Add what the comparison needs of a query, so that it is computed once at ingest: the padded
    text, the squared norm of its gram counts and the highest count."""
    if "q_text" in log.columns:
        return log
    text = log.withColumn("q_text", padded(F.col("normalized_query")))
    return text.withColumn("_runs", gram_runs(F.col("q_text"))).select(
        *text.columns, F.col("_runs.total").alias("q_norm"), F.col("_runs.top").alias("q_top")
    )


def gram_cosine(dot: Column, left: Column, right: Column) -> Column:
    """Cosine from an integer inner product and two squared norms."""
    return F.round(dot.cast("double") / F.sqrt((left * right).cast("double")), DIGITS)


def _keyword_vectors(kw: DataFrame) -> DataFrame:
    """(market, kw_clean, gram, c) of distinct keyword texts with their squared norm, their number
    of grams and their highest count."""
    texts = kw.select("market", "kw_clean").distinct().withColumn("kw_text", padded(F.col("kw_clean")))
    grams = explode_grams(texts, "kw_text").groupBy("market", "kw_clean", "gram").agg(
        F.count(F.lit(1)).alias("c")
    )
    whole = Window.partitionBy("market", "kw_clean")
    return (
        grams.withColumn("kw_norm", F.sum(F.col("c") * F.col("c")).over(whole))
        .withColumn("kw_grams", F.sum("c").over(whole))
        .withColumn("kw_top", F.max("c").over(whole))
    )


def _size_class(norm: Column) -> Column:
    return F.floor(F.log(norm.cast("double")) / F.lit(math.log(CLASS_RATIO))).cast("int")


def _query_class() -> Column:
    """Size class of a query without repeated grams; all others share class -1."""
    return F.when(F.col("q_top") == 1, _size_class(F.col("q_norm"))).otherwise(F.lit(-1))


def _keyword_classes(min_sim: float) -> Column:
    """Size classes of the queries that can reach the floor with a keyword. Without repeats the
    inner product is at most the smaller gram total, which bounds the query's norm both ways."""
    square = min_sim * min_sim
    low = F.col("kw_norm") * F.lit(square - SLACK) / (F.col("kw_top") * F.col("kw_top"))
    high = F.col("kw_grams") * F.col("kw_grams") / (F.col("kw_norm") * F.lit(square - SLACK))
    classes = F.sequence(_size_class(F.greatest(low, F.lit(1.0))), _size_class(F.greatest(high, F.lit(1.0))))
    return F.concat(F.array(F.lit(-1)), classes)


def _ranked(vectors: DataFrame, counts: DataFrame) -> DataFrame:
    """Keyword vectors with ``n``, the occurrences of each gram in the log, and ``weights``, the
    whole vector of the keyword with the rarest gram first."""
    ranked = vectors.join(counts, ["market", "gram"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )
    whole = Window.partitionBy("market", "kw_clean")
    ordered = F.array_sort(F.collect_list(F.struct("n", "gram", "c")).over(whole))
    return ranked.withColumn("weights", ordered)


def _probes(ranked: DataFrame) -> DataFrame:
    """The grams of each keyword that a query must share one of to reach the keyword's ``floor``.

    Grams are taken from the rarest in the log to the most frequent. Once the grams left have a
    norm below ``floor`` times the whole norm, a query that shares only those stays below the
    floor, so they need no probe. ``probe_no`` is the gram's place in ``weights``, ``before`` the
    number of occurrences of the probes before it.
    """
    by_rarity = Window.partitionBy("market", "kw_clean").orderBy("n", "gram")
    rest = by_rarity.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_rarity.rowsBetween(Window.unboundedPreceding, -1)
    enough = F.col("left_norm") >= F.col("kw_norm") * (F.col("floor") * F.col("floor") - SLACK)
    return (
        ranked.withColumn("left_norm", F.sum(F.col("c") * F.col("c")).over(rest))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("probe_no", F.row_number().over(by_rarity))
        .where(enough & (F.col("n") > 0))
    )


def _possible() -> Column:
    """Cheap bounds of the cosine: the inner product is at most the highest count of one side
    times the grams of the other, and grams of the keyword that the query lacks add nothing to
    it. The lack is tested for the keyword's rarest grams."""
    lacking = " + ".join(
        f"if(contains(q_text, rare_{i}), 0, coalesce(rare_{i}_c, 0))" for i in range(RARE)
    )
    need = f"sqrt(double(kw_norm * q_norm)) * (floor - {SLACK!r}D)"
    return F.expr(
        f"{need} <= kw_top * (length(q_text) - {GRAM - 1}) "
        f"and {need} <= q_top * (kw_grams - ({lacking}))"
    )


def _inner_product() -> Column:
    """Inner product of both count vectors; containment is the count when no gram repeats."""
    once = F.aggregate(
        F.col("weights"),
        F.lit(0).cast("bigint"),
        lambda acc, w: acc + F.when(F.contains(F.col("q_text"), w["gram"]), w["c"]).otherwise(0),
    )
    repeated = F.aggregate(
        F.col("weights"),
        F.lit(0).cast("bigint"),
        lambda acc, w: acc
        + w["c"] * F.size(F.filter(gram_list(F.col("q_text")), lambda g: g == w["gram"])),
    )
    return F.when(F.col("q_top") == 1, once).otherwise(repeated)


def _compared(text: DataFrame, ranked: DataFrame, probes: DataFrame, key: list[str], limit: int, salts: int) -> DataFrame:
    """Queries that hold a probe of a keyword text and reach its floor, with their similarity."""
    slim = probes.select(
        *key,
        "kw_clean",
        "floor",
        "probe_no",
        "kw_norm",
        "kw_grams",
        "kw_top",
        *[F.get("weights", F.lit(i))["gram"].alias(f"rare_{i}") for i in range(RARE)],
        *[F.get("weights", F.lit(i))["c"].alias(f"rare_{i}_c") for i in range(RARE)],
    )
    pairs = (
        lookup_join(explode_grams(text, "q_text"), slim, key, limit=limit, salts=salts)
        .where(F.position(F.col("gram"), F.col("q_text")) == F.col("at"))
        .where(_possible())
    )
    whole = ranked.select("market", "kw_clean", "weights").dropDuplicates(["market", "kw_clean"])
    compared = lookup_join(pairs, whole, ["market", "kw_clean"], limit=limit, salts=salts)
    earlier = F.slice("weights", F.lit(1), F.col("probe_no") - 1)
    return (
        compared.where(~F.exists(earlier, lambda w: F.contains(F.col("q_text"), w["gram"])))
        .withColumn(
            "similarity", gram_cosine(_inner_product(), F.col("kw_norm"), F.col("q_norm"))
        )
        .where(F.col("similarity") >= F.col("floor"))
        .select("market", "kw_clean", "id", "normalized_query", *METRICS, "similarity")
    )


def _gram_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all texts as numbers, repeats kept, and the row of each."""
    points, row, left = text_points(texts)
    at, number = numbers_at(points, left, GRAM)
    return number, row[at]


class _KeywordIndex:
    """The grams of one market's keyword texts, each with the keywords that have it."""

    def __init__(self, rows: pa.Table):
        self.texts, kw = np.unique(np.array(rows["kw_clean"].to_pylist(), object), return_inverse=True)
        first = np.unique(kw, return_index=True)[1]
        self.norms = rows["kw_norm"].to_numpy()[first].astype(np.float64)
        self.floors = rows["floor"].to_numpy()[first]
        number = _gram_numbers(rows["gram"].combine_chunks())[0]
        order = np.argsort(number, kind="stable")
        self.grams, self.begins = np.unique(number[order], return_index=True)
        self.sizes = np.diff(np.append(self.begins, len(order)))
        self.kw, self.c = kw[order], rows["c"].to_numpy()[order].astype(np.float64)

    def reached(self, texts: pa.Array, norms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, keywords and inner products of the pairs that may reach the keyword's floor."""
        number, row = _gram_numbers(texts)
        place = np.minimum(np.searchsorted(self.grams, number), len(self.grams) - 1)
        held = self.grams[place] == number
        place, row = place[held], row[held]
        step = max(1, BLOCK // len(self.texts))
        for start in range(0, len(texts), step):
            part = slice(*np.searchsorted(row, [start, start + step]))
            sizes = self.sizes[place[part]]
            at = np.arange(sizes.sum()) + np.repeat(self.begins[place[part]] - np.cumsum(sizes) + sizes, sizes)
            pair = np.repeat(row[part] - start, sizes) * len(self.texts) + self.kw[at]
            dots = np.bincount(pair, self.c[at], min(step, len(texts) - start) * len(self.texts))
            found = np.flatnonzero(dots)
            rows, kw, dots = found // len(self.texts) + start, found % len(self.texts), dots[found]
            near = dots >= np.sqrt(self.norms[kw] * norms[rows]) * (self.floors[kw] - SLACK)
            yield rows[near], kw[near], dots[near].astype(np.int64)


def _scanned(text: DataFrame, ranked: DataFrame) -> DataFrame:
    """What ``_compared`` finds, by a scan: every log row's inner products with all keyword texts
    that share a gram with it, summed over the keywords' lists of its grams. The keyword texts are
    few, as the caller has counted."""
    grams = ranked.select("market", "kw_clean", "gram", "c", "kw_norm", "floor").where("market is not null").toArrow()
    # As tables: a class of this package cannot be read from a broadcast where it is not installed.
    by_market = {m: grams.filter(pc.equal(grams["market"], m)) for m in pc.unique(grams["market"]).to_pylist()}
    shared = text.sparkSession.sparkContext.broadcast(by_market)
    rows = text.select("market", "id", "normalized_query", *METRICS, "q_text", "q_norm")
    schema = text.select("market", "id", "normalized_query", *METRICS, "q_norm").schema
    schema = schema.add("kw_clean", "string").add("kw_norm", "long").add("floor", "double").add("dot", "long")
    names = schema.fieldNames()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: dict[str, _KeywordIndex] = {}
        for batch in batches:
            for market in pc.unique(batch.column("market")).to_pylist():
                if market not in shared.value:
                    continue
                if market not in indexes:
                    indexes[market] = _KeywordIndex(shared.value[market])
                index = indexes[market]
                own = batch.filter(pc.and_(pc.equal(batch.column("market"), market), pc.is_valid(batch.column("q_text"))))
                for at, kw, dots in index.reached(own.column("q_text"), own.column("q_norm").to_numpy().astype(np.float64)):
                    out = {n: own.column(n).take(pa.array(at)) for n in names if n in own.schema.names}
                    out |= {
                        "kw_clean": pa.array(index.texts[kw].tolist(), pa.string()),
                        "kw_norm": pa.array(index.norms[kw].astype(np.int64)),
                        "floor": pa.array(index.floors[kw], pa.float64()),
                        "dot": pa.array(dots),
                    }
                    yield pa.RecordBatch.from_arrays([out[n] for n in names], names)

    found = rows.mapInArrow(scan, schema)
    similarity = gram_cosine(F.col("dot"), F.col("kw_norm"), F.col("q_norm"))
    found = found.withColumn("similarity", similarity).where(F.col("similarity") >= F.col("floor"))
    return found.select("market", "kw_clean", "id", "normalized_query", *METRICS, "similarity")


def gram_topk(
    keywords: DataFrame,
    log: DataFrame,
    k: int = TOP_K,
    min_sim: float = 0.0,
    limit: int = BROADCAST_BYTES,
    salts: int = SALTS,
    counts: DataFrame | None = None,
    scan_texts: int = SCAN_TEXTS,
) -> DataFrame:
    """The ``k`` log rows nearest to each keyword by gram cosine, exact; ties go to the lower id.

    At most ``scan_texts`` distinct keyword texts are compared with every log row in one scan, by
    sums over lists of the keywords of each gram. More of them meet the log in joins:
    with ``min_sim`` the join is on the probe grams and the size classes that can reach it, which
    leaves out the grams and the lengths that most of the log shares. Without a floor each keyword
    gets its own, from the queries that hold its rarest grams. A candidate is compared once: at the first place of the
    first probe gram that its query holds. The k best are taken per distinct keyword text; only
    then they are handed to every theme that uses the text. ``counts`` are stored gram counts of
    the log (see ``query_gram_stats``).
    """
    kw = prepare_keywords(keywords)
    vectors = stage(_keyword_vectors(kw), "keyword-vectors")
    texts, best_first = ["market", "kw_clean"], [F.col("similarity").desc(), F.col("id")]
    few = vectors.select(*texts).distinct().count() <= scan_texts and measure(vectors).fits(limit)
    text = with_gram_text(log).select(
        "market", "id", "normalized_query", *METRICS, "q_text", "q_norm", "q_top"
    )
    themed = kw.select(*KEYWORD_KEY, "kw_clean")

    def scored(near: DataFrame) -> DataFrame:
        found = lookup_join(topk_per(near, texts, best_first, k), themed, texts, limit=limit, salts=salts)
        return found.select(*KEYWORD_KEY, "id", "normalized_query", *METRICS, "similarity")

    if few and min_sim > 0:  # a scan needs no counts of the log
        return scored(_scanned(text, vectors.withColumn("floor", F.lit(min_sim))))
    if counts is None:
        wanted = stage(vectors.select("market", "gram").distinct(), "wanted-grams")
        counts = gram_counts(text, "q_text", (GRAM,), wanted, measure(wanted).fits(limit))
    # Read several times below, and measured before it is broadcast or shuffled.
    ranked = stage(_ranked(vectors, counts).withColumn("floor", F.lit(min_sim)), "keyword-grams")
    key = ["market", "gram"]
    probes = _probes(ranked)
    if min_sim > 0:
        probes = probes.withColumn("q_class", F.explode(_keyword_classes(min_sim)))
        text = text.withColumn("q_class", _query_class())
        key.append("q_class")
    else:
        # The k-th best of the queries that hold a keyword's rarest grams bounds the k-th best of all.
        seeds = topk_per(_compared(text, ranked, probes.where(F.col("before") < k), key, limit, salts), texts, best_first, k)
        kth = F.when(F.count(F.lit(1)) == k, F.min("similarity")).otherwise(0.0)
        floors = stage(seeds.groupBy(*texts).agg(kth.alias("floor")), "floors")
        raised = ranked.drop("floor").join(floors, texts, "left")
        ranked = stage(raised.withColumn("floor", F.coalesce("floor", F.lit(0.0))), "keyword-grams")
        probes = _probes(ranked)
    return scored(_scanned(text, ranked) if few else _compared(text, ranked, probes, key, limit, salts))


def query_gram_stats(log: DataFrame) -> DataFrame:
    """(market, gram, n) of a log's padded texts, to be stored with the log."""
    return gram_counts(with_gram_text(log), "q_text", (GRAM,), None, False)
