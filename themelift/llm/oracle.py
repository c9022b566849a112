"""DuckDB equivalents of the queries that SQL can express."""

from __future__ import annotations

from themelift.llm.quality_rules import CURRENT, POLICIES, RULES
from themelift.llm.secrets import ALLOWED, BASE_KINDS, CLASSES, KINDS, PATTERNS, UNIT, CharacterClass, Pattern

WORDS = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"


def _failures() -> str:
    return " + ".join(f"CASE WHEN {test} THEN {1 << k} ELSE 0 END" for k, (_, test) in enumerate(RULES))


def _breaks(policy: str) -> str:
    return "(" + " OR ".join(f"({test})" for name, test in RULES if name in POLICIES[policy]) + ")"


OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, doc_id, text, {WORDS} AS w,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
m AS (SELECT rid, doc_id, len(w) AS n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        len(regexp_extract_all(text, '!')) AS n_exclaims, len(regexp_extract_all(text, '[|]')) AS n_bars,
        len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_word_repeats FROM t),
p AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS pos FROM t),
g AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, w[pos], w[pos + 1], w[pos + 2]) AS n FROM p),
r AS (SELECT rid, count(DISTINCT place) AS n_repeat_words
        FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS place FROM g WHERE n > 1) GROUP BY rid),
a AS (SELECT m.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN r USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  {_breaks("base")} AS base_failed, NOT {_breaks(CURRENT)} AS kept, ({_failures()})::BIGINT AS failures
FROM a
"""

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex,
        max(page_id) OVER (PARTITION BY html) AS last_id FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(hex, (5 * k + 1)::INTEGER, 5))::BIGINT) AS v FROM h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((v[(i // 4 + 1)::INTEGER] >> (15 - 5 * (i % 4))::INTEGER) & 31))::INTEGER, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM b
"""

OP5 = f"""
WITH d AS (SELECT doc_id, {WORDS.replace("text", "coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS pos FROM d),
h AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY array_to_string(w[pos : pos + 49], ' ')) AS least FROM p),
x AS (SELECT doc_id, list(DISTINCT place) AS gone
        FROM (SELECT doc_id, unnest(range(pos, pos + 50)) AS place FROM h WHERE least < doc_id) GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN x USING (doc_id)),
s AS (SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed, w, gone FROM k)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n_removed = 0 THEN w ELSE
    list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM s
"""

OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ALNUM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SMALL = "abcdefghijklmnopqrstuvwxyz"


def _price(count: str, total: str) -> str:
    return f"(1 + 1000000000::HUGEINT * ({count} + 1) // ({total} + v))"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{SMALL.upper()}', '{SMALL}')"


OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_lower("text")}, '{ALNUM}') AS w FROM documents),
t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
m AS (SELECT rid, doc_id, 25 + (75 * len(w) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
i AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all({_lower("text")}, '{ALNUM}') AS w FROM benchmark),
q AS (SELECT iid, item_id, term, count(*) AS qn FROM (SELECT iid, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
c AS (SELECT iid, item_id, rid, doc_id, sum(qn * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT
          * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
        FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (rid), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, unnest(
          regexp_extract_all(translate(coalesce(text, ''), '{SMALL.upper()}', '{SMALL}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
        FROM documents),
k AS (SELECT lang, term, count(*) AS n FROM d GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
c AS (SELECT d.lang, source, term, count(*) AS n FROM d JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
s AS (SELECT lang, source, coalesce(n_group, 0) AS n_group, coalesce(n_lang, 0) AS n_lang, coalesce(v, 0) AS v FROM g
        LEFT JOIN (SELECT lang, source, sum(n) AS n_group FROM c GROUP BY ALL) USING (lang, source)
        LEFT JOIN (SELECT lang, sum(n) AS n_lang, count(*) AS v FROM k GROUP BY ALL) USING (lang)),
a AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {_price("coalesce(c.n, 0)", "n_group")} AS p,
        {_price("k.n", "n_lang")} AS q
        FROM s JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM a JOIN a AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT s.lang, s.source, 'pair' AS part, z.source AS item, coalesce(f.value, 0) AS value
        FROM s JOIN s AS z ON z.lang = s.lang AND z.source <> s.source
        LEFT JOIN f ON f.lang = s.lang AND f.source = s.source AND f.item = z.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM a WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
        FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""


def _spans(kind: str, expression: str) -> str:
    """rid, m (text of a match), s and e (its start and end) of all matches of a pattern."""
    quoted = expression.replace("'", "''")
    return f"""
{kind}_m AS (SELECT rid, regexp_extract_all(t, '{quoted}') AS a, regexp_split_to_array(t, '{quoted}') AS p FROM d
        WHERE regexp_matches(t, '{quoted}')),
{kind}_k AS (SELECT *, unnest(range(1, len(a) + 1)) AS k FROM {kind}_m),
{kind}_f AS (SELECT rid, a[k] AS m, (list_sum(list_transform(p[:k], lambda x: length(x)))
          + coalesce(list_sum(list_transform(a[:k - 1], lambda x: length(x))), 0))::BIGINT AS s FROM {kind}_k)"""


def _pattern(k: int, pattern: Pattern) -> str:
    quoted = pattern.expression.replace("'", "''")
    return f"""{_spans(pattern.kind, pattern.expression)},
{pattern.kind} AS (SELECT rid, {k} AS k, '{pattern.kind}' AS kind, s, s + length(m) AS e FROM {pattern.kind}_f
        WHERE length(regexp_extract(m, '{quoted}', {pattern.group})) >= {pattern.least})"""


def _class(k: int, c: CharacterClass) -> str:
    allowed = " OR ".join(f"regexp_matches(x, '{a}')" for a in ALLOWED)
    return f"""{_spans(c.kind, c.expression)},
{c.kind}_w AS (SELECT rid, s, m, unnest(range(0, length(m) - {c.window - 1})) AS o FROM {c.kind}_f),
{c.kind}_c AS (SELECT rid, s, o, ch, count(*) AS n
        FROM (SELECT rid, s, o, unnest(string_split(substr(m, o + 1, {c.window}), '')) AS ch FROM {c.kind}_w) GROUP BY ALL),
{c.kind}_h AS (SELECT rid, s, o FROM {c.kind}_c GROUP BY ALL HAVING sum(round({UNIT} * n * log2(n))) <= {c.limit}),
{c.kind}_i AS (SELECT *, sum(new) OVER (PARTITION BY rid, s ORDER BY o) AS island FROM (
        SELECT *, CASE WHEN o > lag(o) OVER (PARTITION BY rid, s ORDER BY o) + {c.window} THEN 1 ELSE 0 END AS new FROM {c.kind}_h)),
{c.kind}_j AS (SELECT rid, s, min(o) AS a, max(o) + {c.window} AS b FROM {c.kind}_i GROUP BY rid, s, island),
{c.kind}_x AS (SELECT j.rid, j.s + a AS s, j.s + b AS e, substr(m, (a + 1)::BIGINT, (b - a)::BIGINT) AS x
        FROM {c.kind}_j AS j JOIN {c.kind}_f AS f ON f.rid = j.rid AND f.s = j.s),
{c.kind} AS (SELECT rid, {k} AS k, '{c.kind}' AS kind, s, e FROM {c.kind}_x WHERE NOT ({allowed}))"""


def _op12() -> str:
    steps = [_pattern(k, p) for k, p in enumerate(PATTERNS)]
    steps += [_class(k, c) for k, c in enumerate(CLASSES, len(PATTERNS))]
    every = " UNION ALL ".join(f"SELECT * FROM {kind}" for kind in KINDS)
    least = len(PATTERNS)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    name = "kind || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{",".join(steps)},
every AS ({every}),
kept AS (SELECT * FROM every AS x WHERE k < {least} OR NOT EXISTS (
        SELECT 1 FROM every AS y WHERE y.rid = x.rid AND y.k < x.k AND y.s <= x.s AND y.e >= x.e)),
told AS (SELECT rid, {counts}, string_agg({name}, ',' ORDER BY s, k) FILTER (k < {least}) AS base,
        string_agg({name}, ',' ORDER BY s, k) AS spans FROM kept GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE_KINDS)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (rid)
"""


ORACLE = {
    "op1_quality_rules": OP1,
    "op2_warc_revisits": OP2,
    "op5_substring_dedup": OP5,
    "op6_exact_top_k": OP6,
    "op11_ranked_search": OP11,
    "op12_secret_scan": _op12(),
    "op13_source_divergence": OP13,
}
