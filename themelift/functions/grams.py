"""Character grams of a text column."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelift.functions.text import clean

# The task code below travels with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM = 3
# Bits of a character in the number of a gram.
POINT_BITS = 21


def padded(c: Column) -> Column:
    """Cleaned text with two leading and one trailing space, the form that gets encoded."""
    return F.concat(F.lit("  "), clean(c), F.lit(" "))


def gram_list(text: Column, size: int = GRAM) -> Column:
    """All grams of a text of at least ``size`` characters, in order, repeats kept."""
    return F.transform(
        F.sequence(F.lit(1), F.length(text) - F.lit(size - 1)),
        lambda i: F.substr(text, i, F.lit(size)),
    )


def explode_grams(df: DataFrame, text: str, sizes: tuple[int, ...] = (GRAM,)) -> DataFrame:
    """One row per position and gram size of ``text``: adds ``at`` (from 1) and ``gram``."""
    at = df.withColumn(
        "at",
        F.explode(
            F.when(
                F.length(text) >= min(sizes),
                F.sequence(F.lit(1), F.length(text) - F.lit(min(sizes) - 1)),
            )
        ),
    )
    if len(sizes) == 1:
        return at.withColumn("gram", F.substr(F.col(text), F.col("at"), F.lit(sizes[0])))
    grams = F.array(
        *[
            F.when(
                F.col("at") + F.lit(n - 1) <= F.length(text),
                F.substr(F.col(text), F.col("at"), F.lit(n)),
            )
            for n in sizes
        ]
    )
    return at.withColumn("gram", F.explode(grams)).where(F.col("gram").isNotNull())


def text_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts, none of them null, one after another; the row of each and how
    many are left of its text, itself included."""
    listed = texts.to_pylist()
    points = np.frombuffer("".join(listed).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, listed), np.int64, len(listed))
    row = np.repeat(np.arange(len(listed)), lengths)
    return points, row, np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))


def numbers_at(points: np.ndarray, left: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a gram of ``size`` characters, ``GRAM`` at most, begins, and a number for it."""
    at = np.flatnonzero(left >= size)
    number = np.zeros(len(at), np.int64)
    for k in range(size):
        number = number << POINT_BITS | points[at + k]
    return at, number


def places_of(known: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of some numbers are among ``known``, which ascends, and their places there."""
    place = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
    held = np.flatnonzero(known[place] == numbers) if len(known) else np.zeros(0, np.int64)
    return held, place[held]


def numbered(grams: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The numbers of distinct grams by their size, ascending, and where each stands in the list."""
    by_size: dict[int, list] = {}
    for place, gram in enumerate(grams):
        number = 0
        for c in gram:
            number = number << POINT_BITS | ord(c)
        by_size.setdefault(len(gram), []).append((number, place))
    return {size: tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) for size, rows in by_size.items()}


def own_rows(batch: pa.RecordBatch, market: str, text: str) -> pa.RecordBatch:
    """The rows of one market whose text is not null."""
    return batch.filter(pc.and_(pc.equal(batch.column("market"), market), pc.is_valid(batch.column(text))))


def counted_grams(texts: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(market, gram, n): occurrences of the wanted grams, which fit a broadcast, in one scan."""
    rows = wanted.select("market", "gram").distinct().where("market is not null and gram is not null").toArrow()
    grams: dict[str, list[str]] = {}
    for market, gram in zip(rows["market"].to_pylist(), rows["gram"].to_pylist(), strict=True):
        grams.setdefault(market, []).append(gram)
    shared = texts.sparkSession.sparkContext.broadcast({m: (g, numbered(g)) for m, g in grams.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {m: np.zeros(len(g), np.int64) for m, (g, _) in shared.value.items()}
        for batch in batches:
            for market in batch.column("market").unique().to_pylist():
                if market not in shared.value:
                    continue
                points, _, left = text_points(own_rows(batch, market, text).column(text))
                for size, (known, place) in shared.value[market][1].items():
                    found = places_of(known, numbers_at(points, left, size)[1])[1]
                    totals[market][place] += np.bincount(found, minlength=len(known))
        for market, n in totals.items():
            at = np.flatnonzero(n)
            names = pa.array([shared.value[market][0][k] for k in at.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(market, len(at)), names, pa.array(n[at])], ["market", "gram", "n"])

    counts = texts.select("market", text).mapInArrow(count, "market string, gram string, n long")
    return counts.groupBy("market", "gram").agg(F.sum("n").alias("n"))
