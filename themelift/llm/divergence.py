"""How far the sources of a language differ in their words: a chi-square-like sum for every pair.

A term is a longest run of ASCII letters and characters beyond ASCII, A-Z lower-cased. Terms in at
least ``LEAST_DOCUMENTS`` documents (rows) of a language are kept; V is their number. A group is a
source of a language. A group of N occurrences gives a term that it has c times the price
p = 1 + 10**9 * (c + 1) div (N + V); two prices differ by f(p, q) = (p - q)**2 div q.

Tasks count their own terms first, so a word that every document has costs a row a task and group.
Kept terms get numbers and are dealt into stretches of about ``STRETCH`` terms of a language; a
group is a sorted array of (term number, count) for each stretch. The arrays meet in pair tasks:
the sources of a language are dealt into blocks, a task has two blocks and one stretch, and merges
the two arrays of each unordered pair. Galloping finds the shorter array's terms in the longer one;
shared terms are priced by both counts, terms of one side by its count and the other side's price
of an absent term, and terms that neither has by one product, all in both directions. No task holds
a whole group, however large, and no row is made for a pair of terms. An array is copied once for
each block of its language. The result has a row for each ordered pair of sources, as asked.

Defined results: a null text, language or source is empty. A group without kept terms prices all of
them as absent; a language without kept terms has V = 0 and all its pairs have value 0. Equal
values rank by the bytes of the name. Whole numbers throughout, exact for totals up to 9e15. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themelift.llm.common import row_groups, text_buffer, tidy, tidy_group
from themelift.llm.terms import LETTERS, term_codes
from themelift.sizing import lookup_join, stage

LEAST_DOCUMENTS = 3
STEPS, STEP = 3, 1_000  # the scale of prices, 10**9, in steps whose products fit 64 bits
STRETCH = 1 << 15
BLOCK = 10
TOP_TERMS = 200
GROUP_TEXT = 8 << 20
ROWS_SENT = 1 << 16


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents that hold it) of the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [batch.column(k).dictionary_encode() for k in (0, 1)]
            lang, source = (x.indices.to_numpy().astype(np.int64) for x in names)
            sources = max(len(names[1].dictionary), 1)
            group = lang * sources + source
            data, offsets = text_buffer(batch.column(2))
            for first, last in row_groups(offsets, GROUP_TEXT):
                codes, bounds, terms = term_codes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], LETTERS)
                size = max(len(terms), 1)
                row = np.repeat(np.arange(last - first), np.diff(bounds))
                held, n = np.unique(row * size + codes, return_counts=True)
                key, at = np.unique(group[first:last][held // size] * size + held % size, return_inverse=True)
                n, df = np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
                for a in range(0, len(key), ROWS_SENT):
                    own = slice(a, a + ROWS_SENT)
                    which = key[own] // size
                    yield pa.RecordBatch.from_arrays(
                        [
                            names[0].dictionary.take(pa.array(which // sources)),
                            names[1].dictionary.take(pa.array(which % sources)),
                            pa.array(terms[key[own] % size], pa.binary()).cast(pa.string()),
                            pa.array(n[own], pa.int64()),
                            pa.array(df[own], pa.int64()),
                        ],
                        ["lang", "source", "term", "n", "df"],
                    )

    counted = _named(docs, "text").mapInArrow(tidy(run), "lang string, source string, term string, n long, df long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _named(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], *more)


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The rows of kept terms: lang, source, term, n, lang_n (the language's occurrences), number
    (of the term, unique) and first (true in one row of each term)."""
    own = Window.partitionBy("lang", "term")
    rows = counts.withColumn("row", F.monotonically_increasing_id()).select(
        "lang", "source", "term", "n", "row",
        F.sum("df").over(own).alias("lang_df"), F.sum("n").over(own).alias("lang_n"), F.min("row").over(own).alias("number"),
    )
    rows = rows.where(F.col("lang_df") >= least)
    return rows.select("lang", "source", "term", "n", "lang_n", "number", (F.col("row") == F.col("number")).alias("first"))


def group_sizes(docs: DataFrame, kept: DataFrame, stretch: int, block: int) -> DataFrame:
    """Every group: lang, source, n_group (its N), n_lang, v, place (among the sources of the
    language), block, blocks and stretches of the language."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.sum(F.col("first").cast("long")).alias("firsts"))
    groups = _named(docs).distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["n_group", "firsts"])
    lang = Window.partitionBy("lang")
    of = groups.select(
        "lang", "source", "n_group",
        F.sum("n_group").over(lang).alias("n_lang"),
        F.sum("firsts").over(lang).alias("v"),
        F.count(F.lit(1)).over(lang).alias("sources"),
        (F.row_number().over(lang.orderBy("source")) - 1).alias("place"),
    )
    return of.select(
        "lang", "source", "n_group", "n_lang", "v", "place",
        F.floor(F.col("place") / block).cast("int").alias("block"),
        F.ceil(F.col("sources") / block).cast("int").alias("blocks"),
        F.greatest(F.ceil(F.col("v") / stretch), F.lit(1)).cast("int").alias("stretches"),
    )


def arrays(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each group and stretch, also where it has no term: lang, place, n_group, v, block,
    blocks, stretch, and the arrays numbers (ascending) and counts."""
    sizes = groups.select("lang", "source", "place", "stretches")
    rows = lookup_join(kept.select("lang", "source", "term", "n", "number"), sizes, ["lang", "source"])
    stretch = F.pmod(F.xxhash64("term"), F.col("stretches")).cast("int").alias("stretch")
    pairs = rows.select("lang", "place", stretch, F.struct("number", "n").alias("pair"))
    own = pairs.groupBy("lang", "place", "stretch").agg(F.sort_array(F.collect_list("pair")).alias("pairs"))
    every = groups.select(
        "lang", "place", "n_group", "v", "block", "blocks",
        F.explode(F.sequence(F.lit(0), F.col("stretches") - 1)).alias("stretch"),
    )
    return every.join(own, ["lang", "place", "stretch"], "left").select(
        *every.columns, F.col("pairs.number").alias("numbers"), F.col("pairs.n").alias("counts")
    )


def gallop(needles: np.ndarray, among: np.ndarray, anchor: int = 32) -> np.ndarray:
    """For each of the ascending needles, the first place in ``among`` (ascending) that is not
    smaller: steps of doubling length from the place of the last anchor, then halving."""
    low = np.repeat(np.searchsorted(among, needles[::anchor]), anchor)[: len(needles)]
    end = len(among)
    step = np.ones(len(needles), np.int64)
    active = np.flatnonzero((low < end) & (among[np.minimum(low, end - 1)] < needles)) if end else np.zeros(0, np.int64)
    moving = active
    while len(moving):
        ahead = low[moving] + step[moving]
        moving = moving[(ahead < end) & (among[np.minimum(ahead, end - 1)] < needles[moving])]
        low[moving] += step[moving]
        step[moving] *= 2
    high = np.minimum(low + step, end)  # low is smaller than the needle, high is not
    while len(active := active[high[active] - low[active] > 1]):
        middle = (low[active] + high[active]) // 2
        less = among[middle] < needles[active]
        low[active[less]], high[active[~less]] = middle[less], middle[~less]
    out = high.copy()
    at_anchor = (low >= end) | (among[np.minimum(low, max(end - 1, 0))] >= needles) if end else np.ones(len(needles), bool)
    out[at_anchor] = low[at_anchor]
    return out


def prices(counts: np.ndarray, total: int, v: int) -> np.ndarray:
    """1 + 10**9 * (counts + 1) div (total + v), by long division in steps."""
    size = max(total + v, 1)
    whole, rest = np.zeros(len(counts), np.int64), counts.astype(np.int64) + 1
    for _ in range(STEPS):
        rest = rest * STEP
        whole, rest = whole * STEP + rest // size, rest % size
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def merged(one: tuple, other: tuple) -> tuple[int, int, int]:
    """Of two groups (numbers, prices, price of an absent term): the sums of f over the terms that
    at least one has, in both directions, and the number of these terms."""
    (numbers, p, p0), (others, q, q0) = one, other
    if len(numbers) > len(others):
        back, forth, n = merged(other, one)
        return forth, back, n
    place = gallop(numbers, others)
    shared = place < len(others)
    shared[shared] = others[place[shared]] == numbers[shared]
    at = place[shared]
    alone = np.ones(len(others), bool)
    alone[at] = False
    forth = apart(p[shared], q[at]).sum() + apart(p[~shared], q0).sum() + apart(p0, q[alone]).sum()
    back = apart(q[at], p[shared]).sum() + apart(q0, p[~shared]).sum() + apart(q[alone], p0).sum()
    return int(forth), int(back), len(numbers) + int(alone.sum())


PAIRS = "lang string, v long, one int, other int, forth long, back long, terms long, forth_absent long, back_absent long"


def pair_sums(rows: DataFrame) -> DataFrame:
    """lang, v, one < other (places of two sources), forth and back: the sums over the terms of all
    stretches that one of them has, terms: how many these are, forth_absent and back_absent: f of a
    term that neither has."""

    def run(table: pa.Table) -> pa.Table:
        lang, v = table["lang"][0].as_py(), table["v"][0].as_py()
        near, far = table["tile"][0]["near"].as_py(), table["tile"][0]["far"].as_py()
        groups: dict[int, tuple] = {}
        block: dict[int, int] = {}
        for row in range(len(table)):
            place, total = table["place"][row].as_py(), table["n_group"][row].as_py()
            numbers, counts = (np.asarray(table[c][row].values if table[c][row].is_valid else [], np.int64) for c in ("numbers", "counts"))
            groups[place] = numbers, prices(counts, total, v), prices(np.zeros(1, np.int64), total, v)
            block[place] = table["block"][row].as_py()
        out = []
        for one in groups:
            for other in groups:
                if one < other and {block[one], block[other]} == {near, far}:
                    absent = groups[one][2], groups[other][2]
                    f = int(apart(*absent)[0]), int(apart(absent[1], absent[0])[0])
                    out.append((lang, v, one, other, *merged(groups[one], groups[other]), *f))
        names = [c.split(" ")[0] for c in PAIRS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
        columns = zip(*out, strict=True) if out else [[] for _ in names]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with_block")
    tiles = rows.select("*", every).select(
        "lang", "v", "place", "n_group", "block", "stretch", "numbers", "counts",
        F.struct(F.least("block", "with_block").alias("near"), F.greatest("block", "with_block").alias("far")).alias("tile"),
    )
    sums = tiles.groupBy("lang", "stretch", "tile").applyInArrow(tidy_group(run), PAIRS)
    return sums.groupBy("lang", "v", "one", "other").agg(
        *[F.sum(c).alias(c) for c in ("forth", "back", "terms")], *[F.max(c).alias(c) for c in ("forth_absent", "back_absent")]
    )


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def price(count: Column, total: Column, v: Column) -> Column:
    """The same as ``prices``, as a column."""
    size = total + v
    whole, rest = F.lit(0).cast("long"), count + 1
    for _ in range(STEPS):
        whole, rest = whole * STEP + div(rest * STEP, size), (rest * STEP) % size
    return whole + 1


def ranked(rows: DataFrame, part: str, limit: int | None = None) -> DataFrame:
    """Rows lang, source, item, value with their part and rank, to the limit if there is one."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    out = out if limit is None else out.where(F.col("rank") <= limit)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def divergence(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, stretch: int = STRETCH, block: int = BLOCK
) -> DataFrame:
    """lang, source, part, item, value and rank. Part ``pair``: every other source of the language,
    the sum of f over all kept terms. Part ``term``: the terms that the group prices higher than its
    language, by f against the language's price, the ``top`` highest."""
    kept = stage(kept_terms(term_counts(docs), least), "kept-terms")
    groups = stage(group_sizes(docs, kept, stretch, block), "groups")
    sums = pair_sums(arrays(kept, groups))
    absent = F.col("v") - F.col("terms")
    ends = F.array(
        F.struct(F.col("one").alias("place"), F.col("other").alias("far"), (F.col("forth") + absent * F.col("forth_absent")).alias("value")),
        F.struct(F.col("other").alias("place"), F.col("one").alias("far"), (F.col("back") + absent * F.col("back_absent")).alias("value")),
    )
    both = sums.select("lang", F.explode(ends).alias("e")).select("lang", "e.*")
    places = groups.select("lang", "place", "source")
    pairs = lookup_join(both, places, ["lang", "place"])
    pairs = lookup_join(pairs, places.select("lang", F.col("place").alias("far"), F.col("source").alias("item")), ["lang", "far"])
    sizes = groups.select("lang", "source", "n_group", "n_lang", "v")
    terms = lookup_join(kept.select("lang", "source", F.col("term").alias("item"), "n", "lang_n"), sizes, ["lang", "source"])
    p, q = price(F.col("n"), F.col("n_group"), F.col("v")), price(F.col("lang_n"), F.col("n_lang"), F.col("v"))
    terms = terms.select("lang", "source", "item", p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", "item", div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term", top))
