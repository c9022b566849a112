"""Histogram gradient-boosted trees over document statistics, applied as flat arrays.

Statistics of all documents are counted once, in tasks. A bounded sample of labelled rows goes to
the driver (at most ``SAMPLE_ROWS`` rows of about twenty numbers), where every feature is cut
into quantile bins and trees are grown level by level from histograms of gradients. A tree of depth
d is a complete binary tree in flat arrays; tasks walk all rows through all trees at once.

Defined results: a null or empty text has all statistics 0 and is scored like any other; without
labels of both classes the score is the share of label 1 (0.5 without any). Several label rows of a
document count once, as 1 if any of them is 1; null labels are left out. Repeated rows have a row
each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themelift.llm.common import held_out, numbered, row_groups, text_buffer, tidy, with_columns
from themelift.llm.doc_stats import counts
from themelift.sizing import lookup_join, stage

SAMPLE_ROWS = 20_000  # labelled rows that the trees are grown from
TREES, DEPTH, BINS = 60, 4, 64
RATE, SMOOTHING, LEAST_WEIGHT = 0.2, 1.0, 2.0
THRESHOLD = 0.3


SHARES_OF_WORDS = (
    "word_chars", "n_symbols", "n_repeat_words", "n_distinct_words", "n_exclaims", "n_bars", "n_stops", "n_commas",
    "n_short_words", "n_long_words", "n_word_repeats", "n_pairs_again",
)
SHARES_OF_BYTES = ("n_upper", "n_digits", "n_wide")
FEATURES = (*SHARES_OF_WORDS, *SHARES_OF_BYTES, "n_dup_lines", "words_a_line", "longest_word", "log_words")


def features(found: dict[str, np.ndarray]) -> np.ndarray:
    """A row of ratios for each text: none grows with its length but the logarithms."""
    words, size, lines = (np.maximum(found[n], 1) for n in ("n_words", "n_bytes", "n_lines"))
    columns = [found[n] / words for n in SHARES_OF_WORDS] + [found[n] / size for n in SHARES_OF_BYTES]
    columns += [found["n_dup_lines"] / lines, np.log1p(found["n_words"] / lines)]
    columns += [np.log1p(found["longest_word"]), np.log1p(found["n_words"])]
    return np.stack(columns, axis=1)


@dataclass
class Trees:
    """Flat arrays, one row per tree: the feature and threshold of each inner node (a row goes right
    if its value is above), the value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row of ``x`` reaches."""
        total = np.full(len(x), self.start)
        if not len(self.leaf):
            return total
        trees, inner = self.feature.shape
        base, row = np.arange(trees) * inner, np.arange(len(x))[:, None]
        feature, threshold = self.feature.ravel(), self.threshold.ravel()
        node = np.zeros((len(x), trees), np.int64)
        while node[:1].max(initial=0) < inner and len(x):
            at = base + node
            node = 2 * node + 1 + (x[row, feature[at]] > threshold[at])
        return total + self.leaf.ravel()[np.arange(trees) * self.leaf.shape[1] + node - inner].sum(axis=1)


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Trees for labels ``y`` of 0 and 1 by logistic loss."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    empty = Trees(np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 0)), start)
    if len(set(y.tolist())) < 2:
        return empty
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    inner = (1 << depth) - 1
    all_feature, all_threshold, all_leaf = [], [], []
    margin = np.full(len(y), start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, weight = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            best = np.full(many, 1e-9)
            chosen = np.zeros(many, np.int64)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                size = len(cut) + 1
                at = (node - first) * size + binned[:, f]
                g = np.bincount(at, slope, many * size).reshape(many, size).cumsum(axis=1)
                h = np.bincount(at, weight, many * size).reshape(many, size).cumsum(axis=1)
                left_g, left_h, g, h = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = left_g**2 / (left_h + SMOOTHING) + (g - left_g) ** 2 / (h - left_h + SMOOTHING) - g**2 / (h + SMOOTHING)
                gain = np.where((left_h >= LEAST_WEIGHT) & (h - left_h >= LEAST_WEIGHT), gain, 0.0)
                place = gain.argmax(axis=1)
                better = gain[np.arange(many), place] > best
                best[better] = gain[np.arange(many), place][better]
                chosen[better] = place[better]
                feature[first : first + many][better] = f
                threshold[first : first + many][better] = cut[place[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        g = np.bincount(node - inner, slope, inner + 1)
        h = np.bincount(node - inner, weight, inner + 1)
        leaf = RATE * g / (h + SMOOTHING)
        margin = margin + leaf[node - inner]
        all_feature.append(feature)
        all_threshold.append(threshold)
        all_leaf.append(leaf)
    return Trees(np.array(all_feature), np.array(all_threshold), np.array(all_leaf), start)


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and y for documents that labels may be learned from."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    return rows.where(~held_out() & F.col("y").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most ``rows`` labelled documents, chosen by a hash of the id."""
    sample = labelled(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = lookup_join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), stage(sample, "sample"), ["doc_id"])
    found = _per_text(joined, ("doc_id", "y"), {n: T.DoubleType() for n in FEATURES}, lambda x: list(x.T))
    got = found.dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    x = np.stack([got[n].to_numpy() for n in FEATURES], axis=1) if len(got) else np.zeros((0, len(FEATURES)))
    return grow(x, got["y"].to_numpy().astype(float))


def _per_text(
    docs: DataFrame,
    keep: tuple[str, ...],
    new: dict[str, T.DataType],
    of: Callable[[np.ndarray], list[np.ndarray]],
    text: str = "text",
) -> DataFrame:
    """The columns ``keep`` and new ones, made from the features of the whole text, which is one of
    the columns kept or another one."""
    sent = keep if text in keep else (*keep, text)
    at = sent.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            for first, last in row_groups(offsets):
                found = counts(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                rows = [batch.column(k).slice(first, last - first) for k in range(len(keep))]
                made = [pa.array(np.ascontiguousarray(c)) for c in of(features(found))]
                yield pa.RecordBatch.from_arrays(rows + made, [*keep, *new])

    return docs.select(*sent).mapInArrow(tidy(run), with_columns(docs, keep, new))


def scored(docs: DataFrame, trees: Trees, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` and _score, the likelihood of label 1."""
    return _per_text(docs, keep, {"_score": T.DoubleType()}, lambda x: [1 / (1 + np.exp(-trees.margins(x)))], text)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(rows, learn(rows, labels, label)).withColumnRenamed("_score", "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""
    rows, named = numbered(docs)
    out = scored(rows, learn(docs, labels, label), tuple(rows.columns), rows.columns[docs.columns.index("text")])
    return out.where(F.col("_score") >= threshold).select(*named)
