"""Typos of keywords in the log, exact, by deletion neighbourhoods of text segments.

A query is a typo of a keyword when the edit distance of their clean forms is below a fifth of the
keyword's length, so a keyword of L letters allows d = ceil(L / 5) - 1 edits. A query of n letters
can be asked for by keywords of at most ``reach(n)`` = (n - 1) div 4 edits. It is cut into
m = reach(n) div 2 + 1 segments of even length. With at most 2 m - 1 edits there is a first segment
i up to which there are at most 2 i + 1 edits; before it there are at least 2 i, so it has one at
most, and the edits around it bound how far the keyword's matching part is shifted.

Two texts with at most one edit between them share a text with at most one letter deleted: the
log's index has each segment and each way to delete a letter from it, hashed together with the
market, the query's length and the segment's number; a keyword asks for its parts at every shift
that the bounds allow. The equi-join on the hash gives candidates; of these, the kinds of letters
leave those that so few edits can reach, and the edit distance decides. A collision of hashes only
adds a candidate.

A query has about as many index rows as letters, whatever the keywords are, so the index can be
stored once (``typo_index``). A log without one is scanned (``typo_scan``), for its index would be
many times its size. A keyword asks for about d**3 parts. Keys that a third of the log
shares cannot pass a join: they hold the query's length and a part of some seven letters; what
remains hot is salted by ``lookup_join``. Texts are matched once and handed to every theme after
that.

Defined results: null texts match nothing. A keyword of up to five letters allows no edit, so only
texts equal to it are its typos. Letters are code points and keep their case. Market and id name a
log row; rows with equal texts are hits of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelift.functions.text import clean, letters
from themelift.operators.keywords import prepare_keywords
from themelift.operators.typo_scan import LONGEST, scanned_typos
from themelift.schemas import HIT_COLUMNS, KEYWORD_KEY, METRICS
from themelift.sizing import BROADCAST_BYTES, SALTS, lookup_join, measure, stage

DIGITS = 9
KEY = ["market", "part"]


def allowed(length: Column) -> Column:
    """Edits that a keyword of so many letters allows: the most that are below a fifth of them."""
    return (F.ceil(length / F.lit(5)) - 1).cast("int")


def reach(length: Column) -> Column:
    """The most edits that any keyword allows which can reach a query of so many letters."""
    return F.greatest(F.floor((length - 1) / F.lit(4)), F.lit(0)).cast("int")


def _segments(length: Column) -> Column:
    return F.floor(reach(length) / F.lit(2)).cast("int") + 1


# Distinct keyword texts with each of which a log row's letters may be compared.
FEW_TEXTS = 4096


def _bound(i: Column, length: Column, segments: Column) -> Column:
    """Letters before segment ``i`` of a text cut evenly."""
    return F.floor(i * length / segments).cast("int")


def _deleted(text: Column) -> Column:
    """Every text with one letter less; none of an empty one."""
    return F.when(
        F.length(text) > 0,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.length(text)),
                lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1, F.length(text))),
            )
        ),
    ).otherwise(F.array())


def _hashed(market: Column, length: Column, segment: Column, text: Column) -> Column:
    return F.xxhash64(market, length, segment, text)


def typo_index(log: DataFrame) -> DataFrame:
    """(market, part, id, q_clean, q_letters): the deletion neighbourhoods of a log's clean texts,
    to be stored with it. The text and its kinds of letters stand beside its parts, so that
    candidates are checked where they are read."""
    return _index_rows(_lettered(log), ["market", "id", "q_clean", "q_letters"])


def _lettered(log: DataFrame) -> DataFrame:
    rows = log.select("market", "id", clean(F.col("normalized_query")).alias("q_clean")).where(F.length("q_clean") > 0)
    return rows.withColumn("q_letters", letters(F.col("q_clean")))


def _alike(rows: DataFrame, keywords: DataFrame) -> DataFrame:
    """Rows whose length and kinds of letters some keyword text allows. The texts are few: a row is
    compared with all that allow its length until one does."""
    texts = keywords.select("market", "kw_clean").distinct()
    n, d = F.length("kw_clean"), allowed(F.length("kw_clean"))
    lengths = texts.select("market", F.explode(F.sequence(n - d, n + d)).alias("_n"), letters(F.col("kw_clean")).alias("kw_letters"), (2 * d).alias("_bits"))
    other = F.broadcast(lengths.distinct().withColumnRenamed("market", "_market"))
    few = F.bit_count(F.col("q_letters").bitwiseXOR(F.col("kw_letters"))) <= F.col("_bits")
    return rows.join(other, (F.col("market") == F.col("_market")) & (F.length("q_clean") == F.col("_n")) & few, "left_semi")


def _index_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows with a non-empty ``q_clean``, one for each part of theirs."""
    n = F.length("q_clean")
    rows = rows.withColumn("_n", n).withColumn("_m", _segments(n))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    begin, end = _bound(F.col("_i"), F.col("_n"), F.col("_m")), _bound(F.col("_i") + 1, F.col("_n"), F.col("_m"))
    rows = rows.withColumn("_segment", F.substr(F.col("q_clean"), begin + 1, end - begin))
    parts = F.concat(F.array("_segment"), _deleted(F.col("_segment")))
    rows = rows.withColumn("_text", F.explode(parts))
    return rows.select(*keep, _hashed(F.col("market"), F.col("_n"), F.col("_i"), F.col("_text")).alias("part"))


def keyword_parts(keywords: DataFrame) -> DataFrame:
    """(market, part, kw_clean, kw_letters) of distinct keyword texts: what their typos have in
    common with them. ``keywords`` are prepared."""
    texts = keywords.select("market", "kw_clean").distinct()
    # By number: a keyword has some hundred parts, so tasks are not to be joined by the bytes of the texts.
    texts = texts.repartition(keywords.sparkSession.sparkContext.defaultParallelism, "kw_clean")
    rows = texts.withColumn("kw_letters", letters(F.col("kw_clean")))
    length, d = F.length("kw_clean"), F.col("_d")
    rows = rows.withColumn("_d", allowed(length))
    lengths = F.sequence(F.greatest(length - d, F.lit(1)), length + d)
    rows = rows.withColumn("_n", F.explode(lengths)).withColumn("_m", _segments(F.col("_n")))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    # More than 2 i edits before the segment are more than the keyword allows.
    rows = rows.where(2 * F.col("_i") <= d)
    shift = F.least(2 * F.col("_i") + 1, d)
    rows = rows.withColumn("_shift", F.explode(F.sequence(-shift, shift)))
    rows = rows.withColumn("_longer", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    begin = _bound(F.col("_i"), F.col("_n"), F.col("_m"))
    size = _bound(F.col("_i") + 1, F.col("_n"), F.col("_m")) - begin
    change, own = F.abs(F.col("_longer")), F.col("_shift") + F.col("_longer")
    before = F.greatest(F.abs(F.col("_shift")), 2 * F.col("_i"))
    after = F.abs(length - F.col("_n") - own)
    start, taken = begin + F.col("_shift"), size + F.col("_longer")
    # The first segment begins both texts, the last one ends both.
    first = (F.col("_i") > 0) | (F.col("_shift") == 0)
    last = (F.col("_i") < F.col("_m") - 1) | (after == 0)
    rows = rows.where(
        first & last & (F.abs(F.col("_shift")) + change <= 2 * F.col("_i") + 1) & (before + change + after <= d)
        & (start >= 0) & (taken >= 0) & (start + taken <= length)
    )
    rows = rows.withColumn("_own", F.substr(F.col("kw_clean"), start + 1, taken))
    # A shorter part is the segment less a letter, a longer one less a letter is the segment, and
    # two of equal length are equal or agree in all but one letter.
    whole = F.array("_own")
    equal = F.when(d == 0, whole).otherwise(F.concat(whole, _deleted(F.col("_own"))))
    texts = F.when(F.col("_longer") < 0, whole).when(F.col("_longer") > 0, _deleted(F.col("_own"))).otherwise(equal)
    rows = rows.withColumn("_text", F.explode(texts))
    return rows.select("market", _hashed(F.col("market"), F.col("_n"), F.col("_i"), F.col("_text")).alias("part"), "kw_clean", "kw_letters").distinct()


def typo_pairs(
    keywords: DataFrame, log: DataFrame, index: DataFrame | None = None, limit: int = BROADCAST_BYTES, salts: int = SALTS
) -> DataFrame:
    """(market, kw_clean, id, edits) of all typos of the distinct texts of prepared keywords.
    ``index`` is the stored ``typo_index`` of the log."""
    asked = stage(keyword_parts(keywords), "keyword-parts")
    size = measure(asked)
    if index is not None:
        held = index
    elif size.fits(limit) and keywords.select("market", "kw_clean").distinct().count() <= FEW_TEXTS:
        # Parts are made of the rows alone that a keyword may reach.
        held = _index_rows(_alike(_lettered(log), keywords), ["market", "id", "q_clean", "q_letters"])
    else:
        held = typo_index(log)
    pairs = lookup_join(held, asked, KEY, limit=limit, salts=salts, size=size)
    d = allowed(F.length("kw_clean"))
    pairs = pairs.where(F.bit_count(F.col("q_letters").bitwiseXOR(F.col("kw_letters"))) <= 2 * d)
    # Beyond the edits allowed the distance is given up and -1.
    edits = F.call_function("levenshtein", F.col("q_clean"), F.col("kw_clean"), d)
    near = pairs.select("market", "kw_clean", "id", edits.alias("edits")).where("edits >= 0")
    return near.groupBy("market", "kw_clean", "id").agg(F.max("edits").alias("edits"))


def _joined(kw: DataFrame, log: DataFrame, index: DataFrame | None, limit: int, salts: int) -> DataFrame:
    """Typos of prepared keywords by a join of parts."""
    pairs = stage(typo_pairs(kw, log, index, limit, salts), "typo-pairs")
    themed = kw.select(*KEYWORD_KEY, "kw_clean")
    hits = lookup_join(pairs, themed, ["market", "kw_clean"], limit=limit, salts=salts)
    columns = log.select("market", "id", "normalized_query", *METRICS)
    found = lookup_join(columns, hits, ["market", "id"], limit=limit, salts=salts)
    return found.select(*KEYWORD_KEY, "id", "normalized_query", *METRICS, "edits")


def typo_join(
    keywords: DataFrame,
    log: DataFrame,
    index: DataFrame | None = None,
    limit: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Every log row that is a typo of a keyword: keyword columns, id, normalized_query, metrics,
    ``edits`` and ``similarity``, one less the edits' share of the keyword's letters, which is
    above 0.8 for every typo. Without a stored index the log is scanned (see ``typo_scan``); keywords
    of more than ``LONGEST`` letters meet the parts of the long texts in a join."""
    kw = prepare_keywords(keywords)
    if index is not None:
        found = _joined(kw, log, index, limit, salts)
    else:
        found = scanned_typos(kw, log, limit)
        far = kw.where(F.length("kw_clean") > LONGEST)
        if found is None or not far.isEmpty():
            long = F.length(clean(F.col("normalized_query"))) >= LONGEST + 1 - (-(-LONGEST // 5))
            more = _joined(far, log.where(long), None, limit, salts)
            found = more if found is None else found.unionByName(more)
    similarity = F.round(1 - F.col("edits") / F.length(clean(F.col("keyword"))), DIGITS)
    return found.withColumn("similarity", similarity)


def typo_hits(typos: DataFrame) -> DataFrame:
    """Typos as hits of the vector part of the score, with their similarity as relevance."""
    return typos.withColumn("method", F.lit("vector")).withColumn("relevance", F.col("similarity")).select(*HIT_COLUMNS)
