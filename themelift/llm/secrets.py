"""Secrets in whole texts: named patterns, and stretches of high Shannon entropy.

Candidate strings are the longest runs of each character class that are at least a window long. A
window slides over a candidate; its entropy follows from the counts of its characters, of which a
step changes two, so that only their two terms of the sum are replaced. Windows at or over the
floor of their class are joined to spans where they touch. A span goes if the allow-list names its
text (numbers, words, ordered alphabets, placeholders, identifiers), or if it lies in a pattern's
span or in a span of an earlier class: it tells nothing new. Pattern spans always stay.

Entropy is compared in whole numbers: n characters with counts c have log2(n) - sum(c*log2(c)) / n
bits, and ``TERMS`` holds c*log2(c) in units of 2**-20, so the decision is the same on every machine.

Texts are searched as bytes with a linear-time expression first; only texts that can hold a span
are looked at further, each on its own, so the memory of a task is that of a batch and some times
its longest text. Nothing is shuffled. Positions are code points, the end exclusive.

Defined results: a null or empty text has no spans. Repeated rows have a row each. All columns
named in ``keep`` are carried, whatever they are called, but for the name of the result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themelift.llm.common import tidy, with_columns

UNIT = 1 << 20


@dataclass(frozen=True)
class Pattern:
    """A kind of span: what matches and how many characters of which group it needs."""

    kind: str
    expression: str
    group: int
    least: int


@dataclass(frozen=True)
class CharacterClass:
    """A kind of span: the characters of a candidate, the window and its least entropy in bits."""

    kind: str
    characters: str
    window: int
    floor: float

    @property
    def expression(self) -> str:
        return f"[{self.characters}]{{{self.window},}}"

    @property
    def limit(self) -> int:
        """The largest sum of ``TERMS`` that a window at the floor has."""
        return math.floor(UNIT * self.window * (math.log2(self.window) - self.floor))


def either_case(word: str) -> str:
    """ASCII letters of either case and no others: case folding of Unicode knows more."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))

#: In the order in which spans with one start are listed.
PATTERNS = (
    Pattern("assign", f"({NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Pattern("access", "AKIA[A-Z0-9]+", 0, 16),
    Pattern("hex", "[0-9a-f]+", 0, 32),
)
CLASSES = (
    CharacterClass("entropy_hex", "0-9A-Fa-f", 24, 3.0),
    CharacterClass("entropy_upper", "0-9A-Z", 20, 3.4),
    CharacterClass("entropy_base64", "0-9A-Za-z+/_=-", 24, 4.0),
)
#: Texts of spans that are no secrets.
ALLOWED = (
    "^[0-9]+$",
    "^[^0-9]+$",
    "(?i)example|sample|placeholder|dummy|xxxxxx",
    "0123456789",
    "(?i)abcdefghij",
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
)
KINDS = tuple(x.kind for x in (*PATTERNS, *CLASSES))
BASE_KINDS = tuple(p.kind for p in PATTERNS)
FOUND = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
)

Span = tuple[int, int, int]  # start, number of the kind, end


def terms(window: int) -> list[int]:
    return [0] + [round(UNIT * c * math.log2(c)) for c in range(1, window + 1)]


def hot_spans(run: bytes, window: int, table: list[int], limit: int) -> list[tuple[int, int]]:
    """Stretches of a candidate that its windows of low enough sum cover, touching ones as one."""
    counts, total = [0] * 256, 0
    spans: list[tuple[int, int]] = []
    for at, c in enumerate(run):
        n = counts[c]
        total += table[n + 1] - table[n]
        counts[c] = n + 1
        begin = at - window + 1
        if begin >= 0 and total <= limit:
            if spans and begin <= spans[-1][1]:
                spans[-1] = (spans[-1][0], at + 1)
            else:
                spans.append((begin, at + 1))
        if begin >= 0:
            c = run[begin]
            n = counts[c]
            total += table[n - 1] - table[n]
            counts[c] = n - 1
    return spans


class Scanner:
    """The expressions and tables of a set of patterns, classes and allowed texts."""

    def __init__(self, patterns: tuple[Pattern, ...], classes: tuple[CharacterClass, ...], allowed: tuple[str, ...]):
        self.patterns = [(p, re.compile(p.expression.encode())) for p in patterns]
        self.classes = [(c, re.compile(c.expression.encode()), terms(c.window), c.limit) for c in classes]
        self.allowed = [re.compile(a.encode()) for a in allowed]
        parts = [f"(?:{p.expression})" if p.group else f"{p.expression[:-1]}{{{self.rest(p)},}}" for p in patterns]
        self.any = "|".join(parts + [c.expression for c in classes])

    @staticmethod
    def rest(pattern: Pattern) -> int:
        """How often the last, repeated set of a pattern without group has to match at least."""
        return pattern.least - len(re.sub(r"\[[^]]*\]\+$", "", pattern.expression))

    def spans(self, text: bytes) -> list[Span]:
        """All spans in bytes, by start and kind."""
        base: list[Span] = []
        for k, (p, expression) in enumerate(self.patterns):
            base += [(m.start(), k, m.end()) for m in expression.finditer(text) if m.end(p.group) - m.start(p.group) >= p.least]
        known, out = list(base), list(base)
        for k, (c, expression, table, limit) in enumerate(self.classes, len(self.patterns)):
            new = []
            for m in expression.finditer(text):
                for a, b in hot_spans(m.group(), c.window, table, limit):
                    a, b = a + m.start(), b + m.start()
                    piece = text[a:b]
                    if not any(x.search(piece) for x in self.allowed):
                        new.append((a, k, b))
            out += uncovered(new, known)
            known += new
        return sorted(out)


def uncovered(spans: list[Span], others: list[Span]) -> list[Span]:
    """The spans that lie in none of the others."""
    if not others:
        return spans
    others = sorted(others)
    starts = np.array([x[0] for x in others])
    reach = np.maximum.accumulate([x[2] for x in others])  # furthest end up to here
    out = []
    for span in spans:
        before = int(np.searchsorted(starts, span[0], "right"))
        if not before or reach[before - 1] < span[2]:
            out.append(span)
    return out


def scan(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    patterns: tuple[Pattern, ...] = PATTERNS,
    classes: tuple[CharacterClass, ...] = CLASSES,
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """The columns ``keep`` and ``found``: kind, start and end of every span of the whole text, by
    start and then in the order of the kinds."""
    kinds = tuple(x.kind for x in (*patterns, *classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(patterns, classes, allowed)
        for batch in batches:
            texts = batch.column(len(keep))
            may = pc.match_substring_regex(texts, own.any)
            found: list = [[] for _ in range(len(texts))]
            for k in pc.indices_nonzero(pc.fill_null(may, False)).to_pylist():
                raw = texts[k].as_py().encode()
                if spans := own.spans(raw):
                    before = np.zeros(len(raw) + 1, np.int64)
                    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=before[1:])
                    found[k] = [{"kind": kinds[n], "start": int(before[a]), "end": int(before[b])} for a, n, b in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, kind)], [*keep, "found"])

    return docs.select(*keep, F.col(text)).mapInArrow(tidy(run), with_columns(docs, keep, {"found": FOUND}))


def of_kinds(*kinds: str) -> Column:
    return F.filter("found", lambda s: s["kind"].isin(*kinds))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas; empty if there are none."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, mark: str = "[secret]", **rules) -> DataFrame:
    """The table with every span of ``text`` replaced by a mark, spans that touch or overlap by one;
    all other columns as they are, a null text stays null."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)]).alias("row"), F.col("text"))
    spans = scan(rows, ("row", "text"), **rules)
    step = F.aggregate(
        "found",
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.concat(
                acc["done"],
                F.when((s["start"] > acc["at"]) | (acc["at"] == 0), F.concat(cut(acc["at"], s["start"]), F.lit(mark))).otherwise(F.lit("")),
            ).alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
    )
    changed = F.concat(step["done"], cut(step["at"], F.length("text")))
    text = F.when(F.size("found") == 0, F.col("text")).otherwise(changed)
    return spans.select(*[text.alias(n) if n == "text" else F.col(f"row.c{k}").alias(n) for k, n in enumerate(names)])


def cut(start: Column, end: Column) -> Column:
    """The characters of ``text`` from start up to end."""
    return F.substring(F.col("text"), (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
