"""Text rules of the matcher as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two space characters that matching ignores, and the markets whose stored
# text is stripped of both in the substring match.
HALF_SPACE = " "
FULL_SPACE = "　"
BOTH_SPACE_MARKETS = ("Japan",)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def clean(c: Column) -> Column:
    """Text without U+0020 and U+3000."""
    return F.translate(c, HALF_SPACE + FULL_SPACE, "")


def clean_for_market(c: Column, market: Column) -> Column:
    """Stored text as the substring match sees it: U+3000 stays outside the listed markets."""
    return F.when(market.isin(*BOTH_SPACE_MARKETS), clean(c)).otherwise(
        F.translate(c, HALF_SPACE, "")
    )


def fold(c: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(c, UPPER, UPPER.lower())


def strip(c: Column) -> Column:
    """Remove white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def hard_relevance(query: Column, keyword: Column) -> Column:
    """Keyword length over the longer of both lengths, spaces not counted; 0 if either is empty."""
    lq, lk = F.length(clean(query)), F.length(clean(keyword))
    return F.when(
        (lq > 0) & (lk > 0), lk.cast("double") / F.greatest(lq, lk).cast("double")
    ).otherwise(F.lit(0.0))


def like_pattern(keyword: Column) -> Column:
    """Infix LIKE pattern in which % and _ of the keyword stay wildcards."""
    return F.concat(F.lit("%"), F.replace(keyword, F.lit("\\"), F.lit("\\\\")), F.lit("%"))


def hard_predicate(
    query: Column, keyword: Column, market: Column, wildcards: bool = False
) -> Column:
    """True when the stored query holds the keyword, spaces and ASCII case ignored."""
    stored = fold(clean_for_market(query, market))
    wanted = fold(clean(keyword))
    if wildcards:
        return F.like(stored, like_pattern(wanted))
    return F.contains(stored, wanted)


def contained(query: Column, keyword: Column) -> Column:
    """Case-sensitive containment, spaces ignored."""
    return F.contains(clean(query), clean(keyword))


def typo(query: Column, keyword: Column) -> Column:
    """Edit distance strictly below a fifth of the keyword length, spaces ignored."""
    q, k = clean(query), clean(keyword)
    allowed = F.length(k).cast("double") / 5.0
    near = F.abs(F.length(q) - F.length(k)).cast("double") < allowed
    return near & (F.levenshtein(q, k).cast("double") < allowed)


def letters(c: Column) -> Column:
    """A bit for each kind of letter that a non-empty text has, letters with equal code points modulo
    64 as one kind. An edit turns two bits at most."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(F.substr(c, i, F.lit(1))) % 64)
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(c)), bit), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def utc_text(ts: Column) -> Column:
    """Timestamp as ``yyyy-MM-dd HH:mm:ss``; the session time zone is expected to be UTC."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
