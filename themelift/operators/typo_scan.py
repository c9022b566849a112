"""Typos of keywords in the log by one scan of its texts for each group of keywords.

The deletion neighbourhoods are those of ``typo_match``, but no row of an index is stored or shuffled:
a task hashes the parts of its own texts and looks them up in a table of the keywords' parts. The
keywords are cut into groups by the length of the queries that they can reach, so that a group's
scan takes only texts of its lengths, and a group's table is held within a measured number of bytes.
For keywords that allow ``WHOLE`` edits at most, what is looked up is the whole text: if d edits make a
keyword of n + x letters from a text of n, both are equal after some d - x letters of the text and d of
the keyword are left out (for x < 0 d and d + x), and nearly every candidate is a typo. Keywords that
allow more edits meet the texts by segments.

Candidates are checked where they are found, by kinds of letters and then by the edit distance, so
that nothing grows with the number of candidates but the time. Part hashes that collide only add
candidates.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themelift.functions.grams import text_points
from themelift.functions.text import clean
from themelift.schemas import KEYWORD_KEY, METRICS
from themelift.sizing import BROADCAST_BYTES, stage

# The task code below travels with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Letters of the longest keyword whose places are worked out; their number grows with the cube.
LONGEST = 64
# The least bytes of a group's table; bytes of a part and of a keyword in it.
LEAST_GROUP = 1 << 16
PART_BYTES, KEYWORD_BYTES = 24, 300
# Rows of texts, candidates and rows of hits that are taken at a time.
TEXTS, ROWS, CANDIDATES, OUT_ROWS = 65_536, 16_384, 1_000_000, 100_000
# The most edits for which all ways to leave out letters of a whole text are hashed.
WHOLE = 2
LETTER, POWER, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9


def allowed(length: int) -> int:
    """Edits that a keyword of so many letters allows."""
    return -(-length // 5) - 1


def segments(n: int) -> int:
    return (n - 1) // 4 // 2 + 1


def left_out(length: int, n: int) -> tuple[int, int]:
    """Letters that are left out of a text and of a keyword that allows few edits."""
    d, longer = allowed(length), length - n
    return d - max(longer, 0), d + min(longer, 0)


def bounds(n: int, m: int) -> list[int]:
    return [i * n // m for i in range(m + 1)]


def places(length: int, n: int) -> list[tuple[int, int, int, int]]:
    """Where a keyword may hold what it shares with a text of ``n`` letters: the text's segment, start
    and number of letters, and whether the letters themselves (1), all but one (2) or both are asked for."""
    d = allowed(length)
    cuts, found = bounds(n, segments(n)), []
    for i in range(len(cuts) - 1):
        # More than 2 i edits before the segment are more than the keyword allows.
        reach = min(2 * i + 1, d)
        for shift in range(-reach, reach + 1) if 2 * i <= d else ():
            for longer in (-1, 0, 1):
                after, start, taken = abs(length - n - shift - longer), cuts[i] + shift, cuts[i + 1] - cuts[i] + longer
                ends = (i > 0 or shift == 0) and (i < len(cuts) - 2 or after == 0)  # both texts begin and end together
                few = abs(shift) + abs(longer) <= 2 * i + 1 and max(abs(shift), 2 * i) + abs(longer) + after <= d
                if ends and few and start >= 0 and taken >= 0 and start + taken <= length:
                    found.append((i, start, taken, {-1: 1, 1: 2}.get(longer, 3 if d else 1)))
    return found


def n_parts(length: int, n: int) -> int:
    if allowed(length) <= WHOLE:
        return comb(length, left_out(length, n)[1])
    return sum((kind & 1) + (kind >> 1) * taken for _, _, taken, kind in places(length, n))


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def _keys(hashes: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of parts as keys that differ by their kind."""
    key = hashes + np.uint64((kind + 1) * LETTER % (1 << 64))
    key ^= key >> np.uint64(32)
    key *= np.uint64(MIX)
    return key ^ key >> np.uint64(29)


def _matrix(points: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    return points[begins[:, None] + np.arange(n)]


class _Hashed:
    """Hashes of parts of texts of one length, from sums over their letters."""

    def __init__(self, matrix: np.ndarray):
        n = matrix.shape[1]
        with np.errstate(over="ignore"):
            letter = (matrix.astype(np.uint64) + np.uint64(1)) * np.uint64(LETTER)
            letter ^= letter >> np.uint64(29)
            power = np.cumprod(np.append(np.uint64(1), np.full(n, POWER, np.uint64)))
            self.back = np.cumprod(np.append(np.uint64(1), np.full(n + 1, pow(POWER, -1, 1 << 64), np.uint64)))
            self.sums = np.zeros((len(matrix), n + 1), np.uint64)
            np.cumsum(letter * power[:n], axis=1, out=self.sums[:, 1:])

    def parts(self, start: int, taken: int, kind: int, i: int) -> np.ndarray:
        """The keys of a part of segment ``i``, whole and with each letter left out, as ``kind`` says, a
        column for each."""
        end, s = start + taken, self.sums
        found = [s[:, end] - s[:, start]] if kind & 1 else []
        if kind & 2:
            found += [s[:, j] - s[:, start] + (s[:, end] - s[:, j + 1]) * self.back[1] for j in range(start, end)]
        if not found:
            return np.zeros((len(s), 0), np.uint64)
        return _keys(np.stack(found, axis=1) * self.back[start], WHOLE + 1 + i)

    def without(self, letters: int, kind: int) -> np.ndarray:
        """The keys of the whole texts with so many letters left out, in each way."""
        n = self.sums.shape[1] - 1
        at = np.array(list(combinations(range(n), letters)), np.int64).reshape(comb(n, letters), letters)
        key, begin = np.zeros((len(self.sums), len(at)), np.uint64), np.zeros(len(at), np.int64)
        for k in range(letters + 1):
            end = at[:, k] if k < letters else np.full(len(at), n)
            key += (self.sums[:, end] - self.sums[:, begin]) * self.back[k]
            begin = end + 1
        return _keys(key, kind)


def _letters(matrix: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduce(np.uint64(1) << (matrix.astype(np.uint64) % np.uint64(64)), axis=1)


class _Table:
    """The parts of one market's keywords for the texts of some lengths."""

    def __init__(self, words: list[str], low: int, high: int):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.most = -(-self.length // 5) - 1
        self.points = np.zeros((len(words), int(self.length.max())), np.uint32)
        self.letters = np.zeros(len(words), np.uint64)
        keys, kws = {}, {}
        self.out: dict[int, set[int]] = {}  # letters to be left out of a text, by its length
        self.cut: set[int] = set()  # lengths of texts that are cut into segments
        for length in np.unique(self.length).tolist():
            own = np.flatnonzero(self.length == length)
            points, _, _ = text_points(pa.array([words[k] for k in own.tolist()], pa.string()))
            matrix = points.reshape(len(own), length)
            self.points[own, :length], self.letters[own] = matrix, _letters(matrix)
            hashed, d = _Hashed(matrix), allowed(length)
            for n in range(max(length - d, 1, low), min(length + d, high) + 1):
                if d <= WHOLE:
                    a, b = left_out(length, n)
                    self.out.setdefault(n, set()).add(a)
                    found = [hashed.without(b, a)]
                else:
                    self.cut.add(n)
                    found = [hashed.parts(start, taken, kind, i) for i, start, taken, kind in places(length, n)]
                for part in found:
                    keys.setdefault(n, []).append(part.ravel())
                    kws.setdefault(n, []).append(np.repeat(own.astype(np.int32), part.shape[1]))
        self.parts = {n: self._sorted(np.concatenate(keys[n]), np.concatenate(kws[n])) for n in keys}

    @staticmethod
    def _sorted(keys: np.ndarray, kw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]:
        """Parts in the order of their keys, and where the keys of each beginning stand."""
        order = np.argsort(keys)
        bits = min(28, max(1, int(len(keys)).bit_length() + 1))
        away = np.uint64(64 - bits)
        counts = np.bincount((keys >> away).astype(np.int64), minlength=1 << bits)
        return keys[order], kw[order], np.append(0, np.cumsum(counts)).astype(np.int32), away

    def typos(self, texts: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, keywords and edits of the typos among texts of one length, ``ROWS`` of them from one on."""
        matrix, n = texts[first : first + ROWS], texts.shape[1]
        none = np.zeros(0, np.int64)
        if n not in self.parts:
            return none, none, none
        keys, kws, begin, away = self.parts[n]
        hashed, letters = _Hashed(matrix), _letters(matrix)
        pairs = [none]
        asked = [hashed.without(a, a) for a in sorted(self.out.get(n, ()))]
        if n in self.cut:
            cuts = bounds(n, segments(n))
            asked += [hashed.parts(a, b - a, 3, i) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        for part in asked:
            place = (part >> away).astype(np.int64).ravel()
            low = begin[place].astype(np.int64)
            size = begin[place + 1] - low
            some = np.flatnonzero(size)
            low, size, key, row = low[some], size[some], part.ravel()[some], some // part.shape[1]
            ends, start = np.cumsum(size), 0
            while start < len(some):
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CANDIDATES, "right")))
                few = slice(start, end)
                at = np.arange(size[few].sum()) + np.repeat(low[few] - np.cumsum(size[few]) + size[few], size[few])
                own = np.repeat(np.arange(start, end), size[few])
                same = keys[at] == key[own]
                kw, own = kws[at[same]], row[own[same]]
                alike = np.bitwise_count(letters[own] ^ self.letters[kw]) <= 2 * self.most[kw]
                pairs.append(_distinct(own[alike] * len(self.length) + kw[alike]))
                start = end
        pair = _distinct(np.concatenate(pairs))
        row, kw = pair // len(self.length), pair % len(self.length)
        edits = np.concatenate([none] + [self._edits(matrix[row[k : k + TEXTS]], kw[k : k + TEXTS]) for k in range(0, len(pair), TEXTS)])
        near = edits <= self.most[kw]
        return row[near] + first, kw[near], edits[near]

    def _edits(self, texts: np.ndarray, kw: np.ndarray) -> np.ndarray:
        """Edit distances of pairs, those above a keyword's edits as some number above them."""
        n, most = texts.shape[1], int(self.most[kw].max())
        left, right = np.ascontiguousarray(texts.T.astype(np.uint32)), np.ascontiguousarray(self.points[kw].T)
        far = 2 * most + 2
        # dp[o] is the distance of the first i letters of the text and the first i + o - most of the keyword.
        dp = [np.full(len(kw), o - most if o >= most else far, np.int16) for o in range(2 * most + 1)]
        for i in range(1, n + 1):
            new = []
            for o in range(2 * most + 1):
                j = i + o - most
                if j < 0 or j > len(right):
                    new.append(np.full(len(kw), far, np.int16))
                    continue
                if j == 0:
                    new.append(np.full(len(kw), i, np.int16))
                    continue
                best = dp[o] + (left[i - 1] != right[j - 1])
                if o + 1 < len(dp):
                    best = np.minimum(best, dp[o + 1] + 1)
                if o:
                    best = np.minimum(best, new[o - 1] + 1)
                new.append(best.astype(np.int16))
            dp = new
        off = self.length[kw] - n + most
        inside = (off >= 0) & (off < len(dp))
        return np.where(inside, np.stack(dp)[np.where(inside, off, 0), np.arange(len(kw))], far).astype(np.int64)


def _groups(counts: dict[int, int], limit: int) -> list[tuple[int, int, int]]:
    """Lengths of texts, from and to, and in how many slices the keywords that reach them are taken, so
    that a table holds about ``limit`` bytes. ``counts`` are the keywords by their letters."""
    limit, sizes = max(limit, LEAST_GROUP), {}
    for length, count in counts.items():
        d = allowed(length)
        for n in range(max(length - d, 1), length + d + 1):
            sizes[n] = sizes.get(n, 0) + count * (n_parts(length, n) * PART_BYTES + KEYWORD_BYTES)
    groups, held = [], 0
    for n in sorted(sizes):
        if groups and groups[-1][2] == 1 and held + sizes[n] <= limit:
            groups[-1] = (groups[-1][0], n, 1)
            held += sizes[n]
        else:
            groups.append((n, n, -(-sizes[n] // limit)))
            held = sizes[n]
    return groups


def _scan(texts: DataFrame, asked: DataFrame, low: int, high: int) -> DataFrame:
    """Log rows of these lengths that are typos of a group's keywords."""
    table = asked.toArrow()
    by_market = {}
    for market in pc.unique(table["market"]).drop_null().to_pylist():
        own = table.filter(pc.equal(table["market"], market)).sort_by("kw_clean")
        words = own["kw_clean"].to_pylist()
        first = np.array([k for k in range(len(words)) if not k or words[k] != words[k - 1]])
        by_market[market] = [words[k] for k in first.tolist()], own.select(KEYWORD_KEY), first
    shared = texts.sparkSession.sparkContext.broadcast((by_market, {}))
    columns = ["id", "normalized_query", *METRICS]
    schema = asked.select(KEYWORD_KEY).schema
    for field in texts.select(columns).schema:
        schema = schema.add(field)
    schema = schema.add("edits", "integer")

    def found(rows: pa.Table, market: str) -> Iterator[pa.RecordBatch]:
        words, names, first = shared.value[0][market]
        tables = shared.value[1]  # kept for the tasks of one worker
        if market not in tables:
            tables[market] = _Table(words, low, high)
        sizes = np.diff(np.append(first, len(names)))
        points, _, _ = text_points(rows["q_clean"].combine_chunks())
        lengths = pc.utf8_length(rows["q_clean"]).to_numpy()
        begins = np.cumsum(lengths) - lengths
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            matrix = _matrix(points, begins[own], n)
            row, kw, edits = (np.concatenate(x) for x in zip(*(tables[market].typos(matrix, k) for k in range(0, len(own), ROWS)), strict=True))
            many = sizes[kw]  # keywords of one text
            key = np.arange(many.sum()) + np.repeat(first[kw] - np.cumsum(many) + many, many)
            row, edits = np.repeat(own[row], many), np.repeat(edits, many)
            for at in range(0, len(key), OUT_ROWS):
                some = slice(at, at + OUT_ROWS)
                left, right = names.take(pa.array(key[some])), rows.select(columns).take(pa.array(row[some]))
                out = [*left.columns, *right.columns, pa.chunked_array([pa.array(edits[some], pa.int32())])]
                yield from pa.Table.from_arrays(out, [*KEYWORD_KEY, *columns, "edits"]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= TEXTS:
                yield from each(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from each(pa.Table.from_batches(held))

    def each(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for market in pc.unique(rows["market"]).drop_null().to_pylist():
            if market in shared.value[0]:
                yield from found(rows.filter(pc.equal(rows["market"], market)), market)

    return texts.where(F.length("q_clean").between(low, high)).mapInArrow(run, schema)


def scanned_typos(kw: DataFrame, log: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame | None:
    """Typos of prepared keywords of at most ``LONGEST`` letters: keyword columns, id, normalized_query,
    metrics and ``edits``; nothing where there are no keywords."""
    asked = stage(kw.where(F.length("kw_clean") <= LONGEST).select(*KEYWORD_KEY, "kw_clean"), "typo-keywords")
    counts = {r["n"]: r["c"] for r in asked.groupBy(F.length("kw_clean").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    texts = log.select("market", "id", "normalized_query", *METRICS, clean(F.col("normalized_query")).alias("q_clean"))
    length, d = F.length("kw_clean"), F.ceil(F.length("kw_clean") / F.lit(5)) - 1
    parts = []
    for low, high, slices in _groups(counts, limit):
        own = asked.where((length - d <= high) & (length + d >= low))
        # By row, so that the many themes of one text are dealt, too.
        number = F.pmod(F.xxhash64(*KEYWORD_KEY), F.lit(slices))
        parts += [_scan(texts, own.where(number == k) if slices > 1 else own, low, high) for k in range(slices)]
    return reduce(DataFrame.unionByName, parts) if parts else None
