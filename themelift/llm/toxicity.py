"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Words are read as bytes (A-Z in lower case) between a run of start marks and an end mark. For each
class there is an order-6 model: discounted counts of a byte after the five before it, and what the
discount frees goes to lower orders. The lower orders are shared: Kneser-Ney continuation counts
(in how many six-byte grams a shorter one ends) over all documents, labelled or not. A spelling that
is rare in a class therefore falls back on what both classes share, and says little; a stem that
only one class has says much, also in a word that was never seen.

Counting runs as Spark aggregations: each task sums the grams of its distinct words, one shuffle
adds them up, and every lower order and every probability is a join of gram tables. The result is a
table of the log-likelihood ratio of every gram of a class and one of every context. Their size is
measured: tables within the limit are broadcast whole; larger ones are joined in Spark to the grams
of the corpus' distinct words, summed per word, and joined back to the words of each document.

A document is described by the length-normalised ratio of its whole text, and by the largest
length-normalised and the largest plain ratio of a word. A logistic curve over these three gives the
score. It is fitted on a sample of at most ``FIT_ROWS`` labelled documents (of those with crc32
modulo 5 equal to 4), described by a model without the sample's labels; the model that scores
counts them too, so that every label is counted.

Labels are only learned from rows that are not held out.

Defined results: a null or empty text has all three numbers 0; without labels of both classes the
score is the share of label 1 (0.5 without any). Several label rows of a document count as 1 if any
of them is 1. Repeated rows have a row each and are counted each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themelift.llm.boosted_trees import labelled
from themelift.llm.common import Flat, WordNumbers, hashes_of, held_out, numbered, row_groups, text_buffer, tidy, with_columns, word_bounds, word_codes
from themelift.llm.simhash import lowered
from themelift.sizing import BROADCAST_BYTES, lookup_join, measure, stage

ORDER = 6
DISCOUNT = 0.75
START, END = 0x01, 0x02  # marks; control characters of a text may equal them
FIT_ROWS = 20_000
WORDS_KEPT = 200_000
ORDINARY, TOXIC, UNKNOWN, SAMPLED = 0, 1, 2, 3  # SAMPLED: ordinary, and after it toxic, in the curve's sample
KINDS = ("c0", "c1", "c2", "s0", "s1")
THRESHOLD = 0.5
DETAILS = ("_whole", "_peak", "_plain_peak")


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of each word, six bytes in a 64-bit number, and the word of each."""
    lead, end = bytes([START]) * (ORDER - 1), bytes([END])
    raw = np.frombuffer(b"".join([lead + w + end for w in words]), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    word = np.repeat(np.arange(len(words)), sizes)
    last = np.arange(len(word)) + (word + 1) * (ORDER - 1)
    gram = np.zeros(len(word), np.int64)
    for back in range(ORDER - 1, -1, -1):
        gram = gram << 8 | raw[last - back]
    return gram, word


class Counter:
    """Counts of grams by class, from counts of distinct words."""

    def __init__(self) -> None:
        self.words = WordNumbers(WORDS_KEPT)
        self.texts: list[bytes] = []
        self.counts = np.zeros((WORDS_KEPT, len(KINDS)), np.int64)

    def add(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.words.full():
            yield from self.grams()
        numbers, bounds, new, _ = self.words.number(data, offsets)
        self.texts += new
        while len(self.counts) < len(self.texts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        each = np.repeat(classes, np.diff(bounds))
        size = len(self.texts)
        self.counts[:size] += np.bincount(numbers * len(KINDS) + each, minlength=size * len(KINDS)).reshape(size, len(KINDS))

    def grams(self) -> Iterator[pa.RecordBatch]:
        """The sums so far; counting starts anew."""
        if self.texts:
            gram, word = grams_of(self.texts)
            distinct, at = np.unique(gram, return_inverse=True)
            sums = [np.bincount(at, self.counts[word, k], len(distinct)).astype(np.int64) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([pa.array(distinct), *map(pa.array, sums)], ["gram", *KINDS])
        self.words.clear()
        self.texts = []
        self.counts[:] = 0


def gram_counts(docs: DataFrame, labels: DataFrame, sample: DataFrame) -> DataFrame:
    """gram and its counts in ordinary (c0), toxic (c1) and all other (c2) documents, and in
    ordinary (s0) and toxic (s1) documents of the sample."""
    in_sample = lookup_join(labels, sample.select("doc_id", F.lit(SAMPLED).alias("from")), ["doc_id"], "left")
    rows = lookup_join(docs.select("doc_id", "text"), stage(in_sample, "counted"), ["doc_id"], "left")
    class_ = F.when(F.col("y") == 0, ORDINARY).when(F.col("y") == 1, TOXIC)
    kind = F.coalesce(class_ + F.coalesce("from", F.lit(0)), F.lit(UNKNOWN)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            classes = batch.column(0).to_numpy()
            data, offsets = text_buffer(batch.column(1))
            for first, last in row_groups(offsets):
                part = lowered(data[offsets[first] : offsets[last]])
                yield from counter.add(part, offsets[first : last + 1] - offsets[first], classes[first:last])
        yield from counter.grams()

    tasks = rows.select(kind.alias("kind"), "text").mapInArrow(tidy(run), "gram long, " + ", ".join(f"{c} long" for c in KINDS))
    return tasks.groupBy("gram").agg(*[F.sum(c).alias(c) for c in KINDS])


def shared_model(grams: DataFrame) -> DataFrame:
    """``tail`` (five bytes) and ``p``, the shared probability of its last byte after the others:
    interpolated Kneser-Ney over continuation counts, order by order."""
    tables = {}
    longer = grams.select(F.col("gram").alias("g"))
    for order in range(ORDER - 1, 0, -1):
        tail = F.col("g").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("g")
        # Staged: it is read three times below, and the next order is counted from it.
        longer = stage(longer.select(tail).groupBy("g").agg(F.count(F.lit(1)).alias("n")), "tails")
        tables[order] = longer
    total = F.lit(1 / 256)
    lower = None
    for order in range(1, ORDER):
        rows = tables[order].withColumn("context", F.shiftright("g", 8))
        sums = rows.groupBy("context").agg(F.sum("n").alias("sum"), F.count(F.lit(1)).alias("kinds"))
        rows = rows.join(sums, "context")
        if lower is None:
            rows = rows.withColumn("q", total)
        else:
            rows = rows.withColumn("below", F.col("g").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1)))
            rows = rows.join(lower, "below")
        p = (F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("q")) / F.col("sum")
        lower = rows.select(F.col("g").alias("below"), p.alias("q"))
    return lower.select(F.col("below").alias("tail"), F.col("q").alias("p"))


def ratios(counts: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """gram, ratio: log of its toxic over its ordinary probability; and context, ratio: the same for a gram that neither class has after a context that one of them has."""
    known = counts.where("c0 + c1 > 0").withColumn("context", F.shiftright("gram", 8))
    sums = known.groupBy("context").agg(
        *[F.sum(c).alias(f"sum_{c}") for c in ("c0", "c1")],
        *[F.count(F.when(F.col(c) > 0, 1)).alias(f"kinds_{c}") for c in ("c0", "c1")],
    )

    def freed(c: str):
        return F.when(F.col(f"sum_{c}") > 0, DISCOUNT * F.col(f"kinds_{c}") / F.col(f"sum_{c}")).otherwise(1.0)

    def probability(c: str):
        own = F.when(F.col(c) > 0, (F.col(c) - DISCOUNT) / F.col(f"sum_{c}")).otherwise(0.0)
        return own + freed(c) * F.col("p")

    tail = F.col("gram").bitwiseAND(F.lit((1 << 8 * (ORDER - 1)) - 1))
    rows = known.join(sums, "context").withColumn("tail", tail).join(shared, "tail")
    ratio = F.log(probability("c1") / probability("c0")).alias("ratio")
    return (
        rows.select("gram", ratio),
        sums.select("context", F.log(freed("c1") / freed("c0")).alias("ratio")),
    )


@dataclass
class Model:
    """Ratios of grams and of contexts (columns gram or context, ratio), and the same as sorted
    arrays where they fit a broadcast."""

    grams: DataFrame
    contexts: DataFrame
    arrays: Broadcast | None


def model_of(grams: DataFrame, contexts: DataFrame, limit: int = BROADCAST_BYTES) -> Model:
    tables = [stage(rows.select(key, F.col("ratio").cast("double").alias("ratio")), f"{key}-ratios") for rows, key in ((grams, "gram"), (contexts, "context"))]
    if sum(measure(t).bytes for t in tables) > limit:
        return Model(*tables, None)
    arrays = []
    for table in tables:
        got = table.toArrow()
        keys, numbers = got.column(0).to_numpy(), got["ratio"].to_numpy()
        order = np.argsort(keys)
        arrays.append((keys[order], numbers[order]))
        del got, keys, numbers
    pa.default_memory_pool().release_unused()
    return Model(*tables, grams.sparkSession.sparkContext.broadcast(arrays))


def found_in(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values of the keys asked for, NaN where there is none."""
    if not len(keys):
        return np.full(len(asked), np.nan)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], np.nan)


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    """The same slots for numbers in a task: XXH64 of the eight bytes, seed 42, as Spark's."""
    p = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]

    def turn(x: np.ndarray, n: int) -> np.ndarray:
        return x << np.uint64(n) | x >> np.uint64(64 - n)

    h = np.full(len(keys), (42 + int(p[4]) + 8) % (1 << 64), np.uint64)
    h ^= turn(keys.astype(np.uint64) * p[1], 31) * p[0]
    h = turn(h, 27) * p[0] + p[3]
    h = (h ^ h >> np.uint64(33)) * p[1]
    h = (h ^ h >> np.uint64(29)) * p[2]
    h ^= h >> np.uint64(32)
    return (h.astype(np.int64) % slots).astype(np.int64)


class Scorer:
    """Ratios of words; each distinct word is summed once and remembered, up to a bound."""

    def __init__(self, model: tuple):
        self.gram, self.context = model
        self.words, self.ratio = WordNumbers(WORDS_KEPT), Flat(np.float64)

    def details(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        numbers, bounds, new, cleared = self.words.number(data, offsets)
        if cleared:
            self.ratio.clear()
        if new:
            gram, word = grams_of(new)
            asked, at = np.unique(gram, return_inverse=True)
            found = found_in(*self.gram, asked)
            other = np.isnan(found)
            found[other] = np.nan_to_num(found_in(*self.context, asked[other] >> 8))
            found = found[at]
            sizes = np.fromiter(map(len, new), np.int64, len(new)) + 1
            both = np.stack([np.bincount(word, found, len(new)), sizes], axis=1)
            self.ratio.add(both.ravel(), np.arange(len(new) + 1) * 2)
        values, _ = self.ratio.fetch(numbers)
        ratio, size = values[::2], values[1::2]
        rows = len(offsets) - 1
        row = np.repeat(np.arange(rows), np.diff(bounds))
        whole = np.bincount(row, ratio, rows) / np.maximum(np.bincount(row, size, rows), 1)
        peak, plain = np.full(rows, -np.inf), np.full(rows, -np.inf)
        np.maximum.at(peak, row, ratio / np.maximum(size, 1))
        np.maximum.at(plain, row, ratio)
        return [whole, np.where(np.isfinite(peak), peak, 0.0), np.where(np.isfinite(plain), plain, 0.0)]


def described(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` and the three numbers of every whole text, which is one of the columns
    kept or another one."""
    if model.arrays is None:
        return joined(docs, model, keep, text)
    sent = keep if text in keep else (*keep, text)
    at = sent.index(text)
    arrays = model.arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(arrays.value)  # freed with the task: workers serve later stages too
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            for first, last in row_groups(offsets):
                part = lowered(data[offsets[first] : offsets[last]])
                found = own.details(part, offsets[first : last + 1] - offsets[first])
                rows = [batch.column(k).slice(first, last - first) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*rows, *map(pa.array, found)], [*keep, *DETAILS])

    schema = with_columns(docs, keep, {n: T.DoubleType() for n in DETAILS})
    return docs.select(*sent).mapInArrow(tidy(run), schema)


def words_of(texts: DataFrame) -> DataFrame:
    """row, word (its hash) and n of the distinct words of each row, and once a group of rows the
    bytes of the word. The table has columns row and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            data, offsets = text_buffer(batch.column(1))
            for first, last in row_groups(offsets):
                part = lowered(data[offsets[first] : offsets[last]])
                starts, ends, row = word_bounds(part, offsets[first : last + 1] - offsets[first])
                each, own = word_codes(part, starts, ends)
                word = hashes_of(own)[:, 0]
                pair, n = np.unique(row * max(len(word), 1) + each, return_counts=True)
                which = pair % max(len(word), 1)
                new = np.zeros(len(pair), bool)
                new[np.unique(which, return_index=True)[1]] = True
                raw = [own[w] if is_new else None for w, is_new in zip(which.tolist(), new.tolist(), strict=True)]
                columns = [numbers[first:last][pair // max(len(word), 1)], word.astype(np.int64)[which], n.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(raw, pa.binary())], ["row", "word", "n", "bytes"])

    return texts.select("row", "text").mapInArrow(tidy(run), "row long, word long, n long, bytes binary")


def word_ratios(words: DataFrame, model: Model) -> DataFrame:
    """word, ratio and size of distinct words (word, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                rows = batch.slice(first, 4096)
                gram, word = grams_of(rows.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(rows.column(0).to_numpy()[word]), pa.array(gram)], ["word", "gram"])

    grams = words.select("word", "bytes").mapInArrow(tidy(run), "word long, gram long")
    grams = lookup_join(grams, model.grams.withColumnRenamed("ratio", "own"), ["gram"], "left")
    grams = lookup_join(grams.withColumn("context", F.shiftright("gram", 8)), model.contexts, ["context"], "left")
    ratio = F.coalesce("own", "ratio", F.lit(0.0))
    return grams.groupBy("word").agg(F.sum(ratio).alias("ratio"), F.count(F.lit(1)).alias("size"))


def joined(docs: DataFrame, model: Model, keep: tuple[str, ...], text: str) -> DataFrame:
    """``described`` by joins, for models of any size."""
    sent = keep if text in keep else (*keep, text)
    rows = stage(docs.select(*sent).withColumn("_row", F.monotonically_increasing_id()), "rows")
    pairs = stage(words_of(rows.select(F.col("_row").alias("row"), F.col(text).alias("text"))), "words")
    words = pairs.where("bytes is not null").groupBy("word").agg(F.min("bytes").alias("bytes"))
    known = stage(word_ratios(words, model), "word-ratios")
    each = lookup_join(pairs.select("row", "word", "n"), known, ["word"])
    numbers = each.groupBy("row").agg(
        (F.sum(F.col("n") * F.col("ratio")) / F.sum(F.col("n") * F.col("size"))).alias(DETAILS[0]),
        F.max(F.col("ratio") / F.col("size")).alias(DETAILS[1]),
        F.max("ratio").alias(DETAILS[2]),
    )
    found = rows.join(numbers, rows["_row"] == numbers["row"], "left")
    return found.select(*keep, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in DETAILS])


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic curve over the columns of ``x`` and, last, its constant: Newton's
    method with a small ridge."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    weights = np.append(np.zeros(x.shape[1]), np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return weights
    full = np.column_stack([x, np.ones(len(x))])
    keep = np.diag(np.append(np.full(x.shape[1], ridge), 1e-6))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ weights, -30, 30)))
        slope = full.T @ (y - p) - keep @ weights
        curve = (full * (p * (1 - p))[:, None]).T @ full + keep
        step = np.linalg.solve(curve, slope)
        weights = weights + step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return weights


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[Model, np.ndarray]:
    """The model and the weights of the curve."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learned = stage(labelled(labels, label), "labels")
    to_fit = learned.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 4)
    sample = stage(to_fit.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS), "sample")
    counts = stage(gram_counts(rows, learned, sample), "grams")
    shared = stage(shared_model(counts), "shared")
    model = model_of(*ratios(counts, shared))
    got = described(lookup_join(rows, sample, ["doc_id"]), model, ("doc_id", "y")).dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    x = np.stack([got[n].to_numpy() for n in DETAILS], axis=1) if len(got) else np.zeros((0, len(DETAILS)))
    if model.arrays is not None:
        model.arrays.destroy()
    del model  # the driver holds one model's arrays at a time
    whole = counts.select("gram", (F.col("c0") + F.col("s0")).alias("c0"), (F.col("c1") + F.col("s1")).alias("c1"))
    model = model_of(*ratios(whole, shared))
    return model, fit_curve(x, got["y"].to_numpy().astype(float))


def scored(docs: DataFrame, model: Model, weights: np.ndarray, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns ``keep`` and _score, the likelihood of label 1."""
    margin = sum((F.col(n) * float(w) for n, w in zip(DETAILS, weights, strict=False)), F.lit(float(weights[-1])))
    return described(docs, model, keep, text).withColumn("_score", 1 / (1 + F.exp(-margin))).drop(*DETAILS)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(rows, *learn(rows, labels, label), ("doc_id",)).withColumnRenamed("_score", "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays under the threshold."""
    rows, named = numbered(docs)
    text = rows.columns[docs.columns.index("text")]
    out = scored(rows, *learn(docs, labels, label), tuple(rows.columns), text)
    return out.where(F.col("_score") < threshold).select(*named)
