"""Substring match of all keywords against the log, as an equi-join on one gram per keyword.

A substring condition has no join key of its own. Every keyword is therefore given one probe gram,
the rarest of its 3-grams in the log; a query can hold the keyword only if it holds that gram. The
log is exploded into (position, gram) rows, joined on (market, gram), and each candidate is checked
with ``position``: it is kept only when the keyword's first occurrence in the query puts the probe
gram at exactly this position, which verifies the match and emits it once. Keywords that fit a
broadcast are instead handed to one scan of the log, which looks up the probe grams at every place
of a block of texts and compares the letters around them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themelift.functions.grams import GRAM, explode_grams, numbered, numbers_at, own_rows, places_of, text_points
from themelift.functions.text import hard_relevance, like_pattern
from themelift.operators.keywords import (
    KeywordProfile,
    gram_counts,
    keyword_grams,
    prepare_keywords,
    profile_keywords,
    rarest_gram,
)
from themelift.schemas import HIT_COLUMNS, KEYWORD_KEY, METRICS
from themelift.sizing import BROADCAST_BYTES, SALTS, lookup_join
from themelift.sources.query_log import with_match_text

# The task code below travels with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOG_COLUMNS = ["market", "id", "normalized_query", *METRICS]


def gram_stats(log: DataFrame, sizes: tuple[int, ...] = (1, 2, GRAM)) -> DataFrame:
    """Gram counts of a log, to be stored with it and passed to every later match."""
    return gram_counts(with_match_text(log), "match_text", sizes, None, False)


def _probes(
    kw: DataFrame, literal: str, text: DataFrame, profile: KeywordProfile, stats: DataFrame | None, fits: bool
) -> DataFrame:
    """Distinct (market, literal) texts with their probe gram."""
    grams = keyword_grams(kw, literal)
    if stats is None:
        wanted = grams.select("market", "gram").distinct()
        stats = gram_counts(text, "match_text", profile.gram_sizes, wanted, fits)
    elif fits:
        stats = stats.join(
            F.broadcast(grams.select("market", "gram").distinct()), ["market", "gram"], "left_semi"
        )
    return rarest_gram(grams, stats, literal)


def with_hit_columns(pairs: DataFrame) -> DataFrame:
    """Matched pairs of keywords and log rows as hits of the substring part of the score."""
    return (
        pairs.withColumn("method", F.lit("hard"))
        .withColumn("relevance", hard_relevance(F.col("normalized_query"), F.col("keyword")))
        .select(*HIT_COLUMNS)
    )


def _probe_lists(rows: pa.Table) -> tuple:
    """Of one market's probes: the texts, their code points, where each begins and how long it is, the
    place of its probe gram, and by gram size the numbers of the grams and the texts of each."""
    texts = rows["kw_fold"].combine_chunks()
    points, _, _ = text_points(texts)
    lengths = np.fromiter(map(len, texts.to_pylist()), np.int64, len(texts))
    grams = pc.unique(rows["gram"]).to_pylist()
    number = {g: i for i, g in enumerate(grams)}
    own = np.array([number[g] for g in rows["gram"].to_pylist()])
    order = np.argsort(own, kind="stable")
    sizes = np.bincount(own, minlength=len(grams))
    lists = order, np.cumsum(sizes) - sizes, sizes
    return texts, points, np.cumsum(lengths) - lengths, lengths, rows["gram_at"].to_numpy().astype(np.int64), numbered(grams), lists


def _held(probes: tuple, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keywords of the pairs whose text holds the keyword, each once."""
    _, kw_points, kw_begin, kw_length, gram_at, known, (order, begins, sizes) = probes
    points, row, left = text_points(texts)
    first = np.concatenate([np.flatnonzero(np.diff(row, prepend=-1)), [len(points)]])
    start_of = np.repeat(first[:-1], np.diff(first))
    pairs = []
    for size, (numbers, gram) in known.items():
        at, number = numbers_at(points, left, size)
        held, place = places_of(numbers, number)
        at, gram = at[held], gram[place]
        n = sizes[gram]
        kw = order[np.arange(n.sum()) + np.repeat(begins[gram] - np.cumsum(n) + n, n)]
        found = np.repeat(at, n)
        start = found - gram_at[kw] + 1
        inside = start >= start_of[found]
        kw, start = kw[inside], start[inside]
        whole = left[start] >= kw_length[kw]
        kw, start = kw[whole], start[whole]
        done, letter = [], 0
        while len(kw):
            over = kw_length[kw] == letter
            done.append(row[start[over]] * len(kw_length) + kw[over])
            same = np.flatnonzero(~over)
            same = same[points[start[same] + letter] == kw_points[kw_begin[kw[same]] + letter]]
            kw, start, letter = kw[same], start[same], letter + 1
        pairs += done
    pair = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return pair // len(kw_length), pair % len(kw_length)


def _scanned(text: DataFrame, probes: DataFrame) -> DataFrame:
    """Log rows with the ``kw_fold`` that they hold, by one scan of the log with all probes."""
    rows = probes.where("market is not null").toArrow()
    by_market = {m: _probe_lists(rows.filter(pc.equal(rows["market"], m))) for m in pc.unique(rows["market"]).to_pylist()}
    shared = text.sparkSession.sparkContext.broadcast(by_market)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for market in batch.column("market").unique().to_pylist():
                if market not in shared.value:
                    continue
                own = own_rows(batch, market, "match_text")
                at, kw = _held(shared.value[market], own.column("match_text"))
                found = own.select(LOG_COLUMNS).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*found.columns, shared.value[market][0].take(pa.array(kw))], [*LOG_COLUMNS, "kw_fold"])

    return text.mapInArrow(scan, text.select(*LOG_COLUMNS).schema.add("kw_fold", "string"))


def hard_match(
    keywords: DataFrame,
    log: DataFrame,
    stats: DataFrame | None = None,
    wildcards: bool = False,
    limit: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """One hit per keyword and log row whose text holds the keyword; score part 2.

    Spaces and ASCII case are ignored. ``stats`` are stored ``gram_stats`` of the log; without them
    the log is scanned once more to count the keywords' grams. With ``wildcards`` the characters %
    and _ of a keyword match any text and any character.
    """
    kw = prepare_keywords(keywords)
    if wildcards:
        return _wildcard_match(kw, log, stats, limit, salts)
    profile = profile_keywords(kw, "kw_fold")
    fits = profile.fits(limit)
    text = with_match_text(log).select(*LOG_COLUMNS, "match_text")
    probes = _probes(kw, "kw_fold", text, profile, stats, fits)
    if fits:
        pairs = _scanned(text, probes)
    else:
        grams = explode_grams(text, "match_text", profile.gram_sizes)
        first = F.position(F.col("kw_fold"), F.col("match_text"))
        pairs = (
            lookup_join(grams, probes, ["market", "gram"], limit=limit, salts=salts, size=profile.size)
            .where((first > 0) & (first == F.col("at") - F.col("gram_at") + 1))
            .select(*LOG_COLUMNS, "kw_fold")
        )
    # Texts are matched once; only then they are handed to every theme that uses them.
    themed = kw.select(*KEYWORD_KEY, "kw_fold")
    key = ["market", "kw_fold"]
    return with_hit_columns(lookup_join(pairs, themed, key, limit=limit, salts=salts, size=profile.size))


def _wildcard_match(
    kw: DataFrame, log: DataFrame, stats: DataFrame | None, limit: int, salts: int
) -> DataFrame:
    """LIKE match. The probe gram comes from the longest literal piece of the keyword; a keyword
    of wildcards only has no piece and is matched by text length."""
    pieces = F.split(F.col("kw_fold"), "[%_]")
    longest = F.element_at(
        F.array_sort(F.transform(pieces, lambda p: F.struct(-F.length(p), p.alias("p")))), 1
    )["p"]
    kw = kw.withColumn("literal", longest)
    profile = profile_keywords(kw, "literal")
    fits = profile.fits(limit)
    text = with_match_text(log).select(*LOG_COLUMNS, "match_text")
    probes = kw.join(_probes(kw, "literal", text, profile, stats, fits), ["market", "literal"])
    grams = explode_grams(text, "match_text", profile.gram_sizes)
    pairs = lookup_join(
        grams, probes, ["market", "gram"], limit=limit, salts=salts, size=profile.size
    ).where(
        (F.position(F.col("gram"), F.col("match_text")) == F.col("at"))
        & F.like(F.col("match_text"), like_pattern(F.col("kw_fold")))
    )
    hits = with_hit_columns(pairs)
    if not profile.has_free:
        return hits
    # Only wildcards: any text with at least as many characters as there are underscores. The
    # condition is an equi-join on market over keywords whose result is the whole market anyway.
    free = kw.where(F.length("literal") == 0).withColumn(
        "_needs", F.length(F.regexp_replace("kw_fold", "[^_]", ""))
    )
    free = F.broadcast(free) if fits else free
    rest = text.join(free, "market").where(F.length("match_text") >= F.col("_needs"))
    return hits.unionByName(with_hit_columns(rest))


def gram_index(log: DataFrame, sizes: tuple[int, ...] = (1, 2, GRAM)) -> DataFrame:
    """Inverted index of a log: one (market, gram, id, match_text) row per distinct gram of a text.
    The text stands beside its postings, so that candidates are verified where they are read."""
    grams = explode_grams(
        with_match_text(log).select("market", "id", "match_text"), "match_text", sizes
    )
    once = F.position(F.col("gram"), F.col("match_text")) == F.col("at")
    return grams.where(once).select("market", "gram", "id", "match_text")


def write_gram_index(index: DataFrame, path: str, buckets: int = 64, files: int = 4) -> None:
    """Store an index by (market, gram bucket), sorted by gram inside the files.

    A bucket is written by several tasks, so a gram that a third of all texts hold does not end
    up in one of them.
    """
    placed = index.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    spread = F.pmod(F.xxhash64("id"), F.lit(files)).cast("int")
    (
        placed.withColumn("_spread", spread)
        .repartition("market", "bucket", "_spread")
        .drop("_spread")
        .sortWithinPartitions("market", "bucket", "gram")
        .write.mode("overwrite")
        .partitionBy("market", "bucket")
        .parquet(path)
    )


def hard_match_indexed(
    keywords: DataFrame,
    index: DataFrame,
    log: DataFrame,
    stats: DataFrame | None = None,
    buckets: int | None = None,
    limit: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Same hits as ``hard_match``, from a stored ``gram_index`` of the log.

    Only postings of the probe grams are read (with ``buckets`` of ``write_gram_index`` the join
    also prunes the index's folders) and verified there; the log is joined by id for the columns of
    the hits alone.
    """
    kw = prepare_keywords(keywords)
    size = profile_keywords(kw, "kw_fold").size
    fits = size.fits(limit)
    grams = keyword_grams(kw, "kw_fold")
    key = ["market", "gram"]
    if stats is None:
        wanted = grams.select(*key).distinct()
        if buckets:
            wanted = wanted.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
        wanted_key = key + (["bucket"] if buckets else [])
        if fits:
            stats = (
                index.join(F.broadcast(wanted), wanted_key, "left_semi")
                .groupBy(*key)
                .agg(F.count(F.lit(1)).alias("n"))
            )
        else:
            stats = index.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    probes = rarest_gram(grams, stats, "kw_fold")
    if buckets:
        probes = probes.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
        key = key + ["bucket"]
    candidates = lookup_join(index, probes, key, limit=limit, salts=salts, size=size)
    found = candidates.where(F.contains(F.col("match_text"), F.col("kw_fold")))
    pairs = log.select(*LOG_COLUMNS).join(found.select("market", "id", "kw_fold"), ["market", "id"])
    themed = kw.select(*KEYWORD_KEY, "kw_fold")
    return with_hit_columns(lookup_join(pairs, themed, ["market", "kw_fold"], limit=limit, salts=salts, size=size))
