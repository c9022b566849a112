"""SQL equivalents of the registered queries, over the same tables.

``CTES`` names the shared steps; ``with_ctes`` puts the ones a query needs in front of it.
"""

from __future__ import annotations

from themelift.functions.text import FULL_SPACE, UPPER
from themelift.operators.inference import API_REASON, EMPTY_REASON, PARSE_REASON
from themelift.plans.fixtures import MARKET, WORD_BREAK

LOWER = UPPER.lower()

# The accented letters of the documents and one ASCII stand-in for each, because the
# SQL engine's edit distance counts bytes.
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß"
STAND_INS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*"


def fold(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{LOWER}')"


def clean(c: str) -> str:
    return f"translate({c}, ' {FULL_SPACE}', '')"


def half_clean(c: str) -> str:
    return f"replace({c}, ' ', '')"


def relevance(q: str, k: str) -> str:
    lq, lk = f"length({clean(q)})", f"length({clean(k)})"
    return (
        f"CASE WHEN {lq} > 0 AND {lk} > 0 THEN CAST({lk} AS DOUBLE) / greatest({lq}, {lk}) "
        "ELSE CAST(0 AS DOUBLE) END"
    )


def plain(c: str) -> str:
    return f"translate({clean(c)}, '{ACCENTED}', '{STAND_INS}')"


def typo(q: str, k: str) -> str:
    return f"CAST(levenshtein({plain(q)}, {plain(k)}) AS DOUBLE) < CAST(length({clean(k)}) AS DOUBLE) / 5"


def hard(log: str, kw: str) -> str:
    """All pairs of a keyword and a log row that holds it."""
    return f"""SELECT k.* EXCLUDE (wanted), l.id, l.normalized_query, l."SRPV", l."AdClick", l.revenue, 'hard' AS method,
 {relevance('l.normalized_query', 'k.keyword')} AS relevance
 FROM (SELECT *, {fold(clean('keyword'))} AS wanted FROM {kw}) k
 JOIN (SELECT *, {fold(half_clean('normalized_query'))} AS stored FROM {log}) l
 ON contains(l.stored, k.wanted) WHERE l.market = k.market"""


def typos(log: str, kw: str) -> str:
    """All pairs of a keyword and a log row that differ in fewer edits than a fifth of the keyword.
    Of d + 1 pieces of the keyword, d edits leave one as it is, so pairs without any are not compared."""
    pieces = ", ".join(
        f"CASE WHEN d >= {i} THEN substring(b, {i} * n // (d + 1) + 1, {i + 1} * n // (d + 1) - {i} * n // (d + 1)) END AS p{i}"
        for i in range(5)
    )
    holds = " OR ".join(f"contains(a, p{i})" for i in range(5))
    return f"""SELECT * EXCLUDE (a, b, n, d, m, p0, p1, p2, p3, p4, kw_market), round(1 - CAST(edits AS DOUBLE) / n, 9) AS similarity
 FROM (SELECT k.*, l.*, levenshtein(a, b) AS edits
  FROM (SELECT *, {pieces}, unnest(range(n - d, n + d + 1)) AS m
   FROM (SELECT * EXCLUDE (market), market AS kw_market, {plain('keyword')} AS b, length({clean('keyword')}) AS n,
     (length({clean('keyword')}) + 4) // 5 - 1 AS d FROM {kw}) WHERE n > 0) k
  JOIN (SELECT *, {plain('normalized_query')} AS a FROM {log}) l ON length(a) = m AND kw_market = market
  WHERE d > 4 OR {holds}) WHERE edits <= d"""


def cents(net: str) -> str:
    return f"CAST(({net} + 50) // 100 AS DOUBLE) / 100"


PART_TEXT = """(CASE WHEN p_partkey % 7 = 0 THEN substring(p_name, 1, 3) || substring(p_name, 5)
 ELSE p_name END) || (CASE WHEN p_partkey % 3 = 0 THEN ' ' || lower(p_type) ELSE '' END)"""
NOUN = "string_split(p_name, ' ')[-1]"
ADJECTIVE = "string_split(p_name, ' ')[1]"

HIT_SELECT = """theme, kw_pos, keyword, id, normalized_query, "SRPV", method, round(relevance, 9) AS relevance"""

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (list(needs), body)


cte(
    "line_sums",
    """SELECT l_partkey, count(*) AS srpv, count(*) FILTER (WHERE l_returnflag = 'R') AS adclick,
 CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS net
 FROM lineitem GROUP BY l_partkey""",
)
cte(
    "raw_rows",
    f"""SELECT p_partkey AS id, {PART_TEXT} AS normalized_query, coalesce(srpv, 0) AS srpv,
 coalesce(adclick, 0) AS adclick, coalesce(net, 0) AS net
 FROM part LEFT JOIN line_sums ON p_partkey = l_partkey""",
    "line_sums",
)
cte(
    "log_rows",
    f"""SELECT id, normalized_query, srpv AS "SRPV", adclick AS "AdClick", {cents('net')} AS revenue, '{MARKET}' AS market
 FROM raw_rows""",
    "raw_rows",
)
cte(
    "log",
    f"""SELECT min(id) AS id, normalized_query, CAST(sum(srpv) AS BIGINT) AS "SRPV", CAST(sum(adclick) AS BIGINT) AS "AdClick",
 {cents('CAST(sum(net) AS BIGINT)')} AS revenue, '{MARKET}' AS market FROM raw_rows GROUP BY normalized_query""",
    "raw_rows",
)
cte(
    "named",
    f"SELECT p_partkey, p_name, {NOUN} AS theme, {ADJECTIVE} AS adjective FROM part",
)
cte(
    "kw",
    f"""SELECT theme_pos, theme, '{MARKET}' AS market,
 row_number() OVER (PARTITION BY theme ORDER BY length(keyword), keyword) - 1 AS kw_pos, keyword
 FROM (SELECT t.theme_pos, n.theme, n.keyword FROM (SELECT DISTINCT theme, p_name AS keyword FROM named
   UNION ALL SELECT DISTINCT theme, 'zzz ' || theme FROM named) n
  JOIN (SELECT theme, min(p_partkey) AS theme_pos FROM named GROUP BY theme) t ON n.theme = t.theme
  UNION ALL SELECT -1 - r_regionkey, lower(r_name), lower(r_name) FROM region)""",
    "named",
)
cte(
    "pair_words",
    f"""SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{WORD_BREAK}'), lambda w: length(w) > 0) AS words
 FROM documents""",
)
cte(
    "pair_log",
    f"""SELECT row_number() OVER (ORDER BY first_place) - 1 AS id, normalized_query, "SRPV", "AdClick",
 CAST(0 AS DOUBLE) AS revenue, '{MARKET}' AS market
 FROM (SELECT min({{'doc': doc_id, 'place': i}}) AS first_place, q AS normalized_query, count(*) AS "SRPV",
  count(DISTINCT doc_id) AS "AdClick"
  FROM (SELECT doc_id, i, words[i] || ' ' || words[i + 1] AS q FROM pair_words, unnest(range(1, len(words))) u(i))
  GROUP BY q)""",
    "pair_words",
)
cte(
    "pair_kw",
    f"""SELECT CAST(substring(source, 4) AS BIGINT) AS theme_pos, source AS theme, '{MARKET}' AS market,
 length(word) AS kw_pos, max(word) AS keyword
 FROM (SELECT d.source, unnest(list_distinct(p.words)) AS word FROM documents d JOIN pair_words p ON d.doc_id = p.doc_id)
 GROUP BY source, length(word)""",
    "pair_words",
)

cte(
    "pair_samples",
    f"""SELECT id % 1000 // 50 AS theme_pos, 'every 50th ' || id % 1000 // 50 AS theme, '{MARKET}' AS market, id AS kw_pos,
 normalized_query AS keyword FROM pair_log WHERE id % 50 = 0""",
    "pair_log",
)


def matching(log: str, kw: str, prefix: str) -> None:
    """Steps of the match of keyword table ``kw`` with ``log``, named with ``prefix``."""
    cte(
        f"{prefix}hard",
        hard(log, kw),
        log,
        kw,
    )
    for side, source, key, column in [("q", log, "id", "normalized_query"), ("k", kw, "keyword", "keyword")]:
        cte(
            f"{prefix}{side}_grams",
            f"""SELECT {key}, g, count(*) AS c FROM (SELECT {key}, substring(t, CAST(i AS BIGINT), 3) AS g
 FROM (SELECT DISTINCT {key}, '  ' || {clean(column)} || ' ' AS t FROM {source}), unnest(range(1, length(t) - 1)) u(i))
 GROUP BY {key}, g""",
            source,
        )
    cte(
        f"{prefix}cosine",
        f"""SELECT d.keyword, d.id, round(d.dot / sqrt(CAST(nk.n * nq.n AS DOUBLE)), 9) AS similarity
 FROM (SELECT k.keyword, q.id, CAST(sum(k.c * q.c) AS DOUBLE) AS dot FROM {prefix}k_grams k JOIN {prefix}q_grams q ON k.g = q.g
  GROUP BY k.keyword, q.id) d
 JOIN (SELECT keyword, sum(c * c) AS n FROM {prefix}k_grams GROUP BY keyword) nk ON nk.keyword = d.keyword
 JOIN (SELECT id, sum(c * c) AS n FROM {prefix}q_grams GROUP BY id) nq ON nq.id = d.id""",
        f"{prefix}k_grams",
        f"{prefix}q_grams",
    )
    cte(
        f"{prefix}near",
        f"""SELECT * EXCLUDE (rn) FROM (SELECT k.*, l.id, l.normalized_query, l."SRPV", l."AdClick", l.revenue, c.similarity,
 row_number() OVER (PARTITION BY k.theme_pos, k.kw_pos ORDER BY c.similarity DESC, l.id) AS rn
 FROM {prefix}cosine c JOIN {kw} k ON k.keyword = c.keyword JOIN {log} l ON l.id = c.id) WHERE rn <= 100""",
        f"{prefix}cosine",
        kw,
        log,
    )
    cte(
        f"{prefix}verified",
        f"""SELECT * EXCLUDE (similarity), 'vector' AS method, similarity AS relevance FROM {prefix}near
 WHERE similarity >= 0.8 AND (contains({clean('normalized_query')}, {clean('keyword')}) OR {typo('normalized_query', 'keyword')})""",
        f"{prefix}near",
    )
    cte(f"{prefix}typos", typos(log, kw), log, kw)
    cte(
        f"{prefix}hits",
        f"""SELECT * FROM {prefix}hard UNION ALL BY NAME SELECT * EXCLUDE (relevance), max(relevance) AS relevance
 FROM (SELECT * FROM {prefix}verified UNION ALL BY NAME SELECT * EXCLUDE (similarity, edits), similarity AS relevance, 'vector' AS method
  FROM {prefix}typos) GROUP BY ALL""",
        f"{prefix}hard",
        f"{prefix}verified",
        f"{prefix}typos",
    )
    cte(
        f"{prefix}merged",
        f"""SELECT theme_pos, theme, market, normalized_query, score_hard, score_vector, score_hard + score_vector AS "Score",
 "Relevance", matched_keyword, "SRPV", "AdClick", revenue FROM (
 SELECT theme_pos, theme, market, normalized_query, max(CASE WHEN method = 'hard' THEN 2 ELSE 0 END) AS score_hard,
 max(CASE WHEN method = 'vector' THEN 1 ELSE 0 END) AS score_vector, round(max(relevance), 9) AS "Relevance",
 arg_min(keyword, length(keyword) * 1000000 + kw_pos) AS matched_keyword, arg_min("SRPV", id) AS "SRPV",
 arg_min("AdClick", id) AS "AdClick", arg_min(revenue, id) AS revenue
 FROM {prefix}hits GROUP BY theme_pos, theme, market, normalized_query)""",
        f"{prefix}hits",
    )
    cte(
        f"{prefix}results",
        f"""SELECT * EXCLUDE (score_hard, score_vector) FROM {prefix}merged WHERE "Relevance" >= 0.4""",
        f"{prefix}merged",
    )


matching("log", "kw", "")
matching("pair_log", "pair_kw", "pair_")

cte("brands", "SELECT theme AS brand, CASE WHEN theme = 'widget' THEN 'gizmo' END AS parent, theme IN ('ring', 'plate') AS common, coalesce(list(DISTINCT adjective) FILTER (WHERE length(adjective) % 2 = 0), []) AS terms FROM named GROUP BY theme", "named")
cte(
    "brand_queries",
    f"""SELECT theme_pos, theme, CASE c WHEN 0 THEN adjective || ' ' || theme WHEN 1 THEN theme || ' vs ' || other
 WHEN 2 THEN other || ' ' || theme WHEN 3 THEN theme || 's ' || kind WHEN 4 THEN theme || adjective
 ELSE kind || ' ' || adjective END AS normalized_query
 FROM (SELECT p_partkey AS theme_pos, {NOUN} AS theme, {ADJECTIVE} AS adjective, lower(p_type) AS kind,
  ['anvil', 'gizmo', 'rod', 'widget'][CAST(p_size % 4 + 1 AS BIGINT)] AS other, p_partkey % 6 AS c FROM part)""",
)


def flagged(name: str, source: str, column: str = "normalized_query") -> None:
    """Rows of ``source`` with one column per brand rule."""
    text = clean(f"lower({column})")
    words = f"list_filter(string_split(lower({column}), ' '), lambda w: length(w) > 0 AND w <> theme AND w <> theme || 's')"
    cte(
        name,
        f"""SELECT r.* EXCLUDE (text, residual, rest, comparing, parent, terms),
 NOT contains(text, theme) AS no_identity,
 coalesce(o.brand IS NOT NULL AND residual IS DISTINCT FROM r.parent, false) AS other_brand,
 coalesce(comparing AND c.brand IS NOT NULL AND c.brand IS DISTINCT FROM r.parent, false) AS comparison,
 list_has_any(rest, r.terms) OR list_contains(r.terms, residual) AS off_topic
 FROM (SELECT s.*, b.parent, b.terms, {text} AS text, replace(replace({text}, theme || 's', ''), theme, '') AS residual,
  {words} AS rest, list_has_any(string_split(lower({column}), ' '), ['vs', 'versus']) AS comparing
  FROM {source} s JOIN brands b ON b.brand = s.theme) r
 LEFT JOIN brands o ON o.brand = residual
 LEFT JOIN brands c ON c.brand = array_to_string(list_filter(rest, lambda w: w NOT IN ('vs', 'versus')), '')""",
        source,
        "brands",
    )


REASON = """CASE WHEN no_identity THEN 'Brand not named' WHEN other_brand THEN 'Other brand'
 WHEN comparison THEN 'Comparison with other brand' WHEN off_topic THEN 'Unrelated concept' ELSE '' END"""

flagged("flagged_results", "results")
flagged("flagged_queries", "brand_queries")
cte(
    "final",
    f"""SELECT * EXCLUDE (no_identity, other_brand, comparison, off_topic, reason), reason = '' AS "AI_Valid", reason AS "AI_Reason"
 FROM (SELECT *, {REASON} AS reason FROM flagged_results)""",
    "flagged_results",
)
RANK = """row_number() OVER (PARTITION BY theme_pos ORDER BY "Score" DESC, "Relevance" DESC, "SRPV" DESC, normalized_query) - 1"""
cte("ranked", f"SELECT *, {RANK} AS rank_pos, ({RANK}) // 25 AS batch_index FROM final", "final")
cte(
    "judged",
    f"""SELECT * EXCLUDE (rule_valid, rule_reason, taken_back, missing),
 CASE WHEN taken_back THEN NOT rule_valid WHEN missing THEN true ELSE rule_valid END AS "AI_Valid",
 CASE WHEN taken_back THEN 'Second look' WHEN missing THEN '{API_REASON}' ELSE rule_reason END AS "AI_Reason"
 FROM (SELECT * EXCLUDE ("AI_Valid", "AI_Reason"), "AI_Valid" AS rule_valid, "AI_Reason" AS rule_reason,
  rank_pos % 25 = 0 AND batch_index < max(batch_index) OVER (PARTITION BY theme_pos) AND (batch_index + 1) % 4 <> 3 AS taken_back,
  batch_index % 4 = 3 AS missing FROM ranked)""",
    "ranked",
)
cte(
    "batch_verdicts",
    f"""SELECT theme_pos, batch_index, normalized_query, "AI_Valid" AS is_valid, "AI_Reason" AS reason FROM ranked WHERE batch_index % 4 <> 3
 UNION ALL SELECT theme_pos, batch_index, normalized_query, true, '{API_REASON}' FROM ranked WHERE batch_index % 4 = 3
 UNION ALL SELECT r.theme_pos, r.batch_index + 1, r.normalized_query, NOT "AI_Valid", 'Second look' FROM ranked r
  JOIN (SELECT theme_pos, max(batch_index) AS last FROM ranked GROUP BY theme_pos) m ON m.theme_pos = r.theme_pos
  WHERE rank_pos % 25 = 0 AND batch_index < last AND (batch_index + 1) % 4 <> 3""",
    "ranked",
)
cte(
    "vector_results",
    f"""SELECT * FROM (SELECT theme_pos, theme, '{MARKET}' AS market, normalized_query, CAST(max(hard) + max(vec) AS INTEGER) AS "Score",
  round(max(relevance), 9) AS "Relevance", arg_min(keyword, length(keyword) * 1000000 + kw_pos) AS matched_keyword, arg_min("SRPV", id) AS "SRPV", arg_min("AdClick", id) AS "AdClick"
  FROM (SELECT k.*, l.id, l.normalized_query, l."SRPV", l."AdClick", 2 AS hard, 0 AS vec, {relevance('l.normalized_query', 'k.keyword')} AS relevance
   FROM vector_kw k JOIN log_rows l ON contains({fold(half_clean('l.normalized_query'))}, {fold(clean('k.keyword'))})
   UNION ALL SELECT k.*, l.id, l.normalized_query, l."SRPV", l."AdClick", 0, 1, n.similarity
   FROM vector_kw k JOIN neighbours n ON n.keyword = 'vector ' || k.kw_pos JOIN log_rows l ON l.id = n.id + 1
   WHERE n.similarity >= 0.1 AND (contains({clean('l.normalized_query')}, {clean('k.keyword')}) OR {typo('l.normalized_query', 'k.keyword')}))
  GROUP BY theme_pos, theme, normalized_query) WHERE "Relevance" >= 0.4""",
    "vector_kw",
    "neighbours",
    "log_rows",
)
cte("asked_vectors", "SELECT label, vec_id, embedding AS anchor FROM embeddings WHERE vec_id % 50 = 0")
cte(
    "vector_kw",
    """SELECT CAST(label AS BIGINT) AS theme_pos, 'label ' || label AS theme, vec_id AS kw_pos, p_name AS keyword
 FROM asked_vectors JOIN part ON p_partkey = vec_id + 1""",
    "asked_vectors",
)
cte(
    "events_in_jobs",
    """SELECT CAST(user_id AS VARCHAR) || '|' || strftime(ts, '%Y-%m-%d') AS job_id, * FROM events""",
)
cte(
    "tasks",
    """SELECT job_id, job_id || '-' || event_type AS theme_id, event_type AS theme,
 CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status,
 strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created_at, count(*) AS match_count,
 CAST(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS DOUBLE) / 100 AS elapsed_sec
 FROM events_in_jobs GROUP BY job_id, event_type""",
    "events_in_jobs",
)
cte(
    "job_states",
    "SELECT job_id, CASE WHEN bool_or(status = 'error') THEN 'error' ELSE 'done' END AS status, count(*) AS n_tasks FROM tasks GROUP BY job_id",
    "tasks",
)
cte(
    "spaced",
    f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '{FULL_SPACE}')
 WHEN 1 THEN upper(p_name) || ' ' || p_type ELSE p_name END AS query,
 CASE WHEN p_partkey % 2 = 0 THEN 'Japan' ELSE '{MARKET}' END AS market, {NOUN} AS noun, p_name FROM part""",
)
STORED = f"CASE WHEN market = 'Japan' THEN {clean('query')} ELSE {half_clean('query')} END"
cte(
    "anchors",
    "SELECT label, min(vec_id) AS vec_id, arg_min(embedding, vec_id) AS anchor FROM embeddings GROUP BY label",
)
DOT = "list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(a.anchor AS DOUBLE[]))"
cte(
    "neighbours",
    f"""SELECT * EXCLUDE (rn) FROM (SELECT 'label ' || a.label AS theme, 'vector ' || a.vec_id AS keyword, e.vec_id AS id,
 round({DOT}, 9) AS similarity,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY round({DOT}, 9) DESC, e.vec_id) AS rn
 FROM embeddings e CROSS JOIN asked_vectors a) WHERE rn <= 100""",
    "asked_vectors",
)
cte(
    "markets",
    """SELECT n_name AS market, 'm' || n_nationkey AS code,
 CASE WHEN r_regionkey = 0 THEN 'English' ELSE lower(r_name) || ', English' END AS languages,
 CASE WHEN r_regionkey = 0 THEN 'English' ELSE lower(r_name) END AS primary_language,
 r_regionkey = 0 AS english_only, 'encoder-' || lower(r_name) AS encoder, 'logs/market=' || n_name AS log_path,
 CASE WHEN n_nationkey % 5 = 4 THEN 'log_' || n_name END AS dedicated_table, 'keywords-m' || n_nationkey AS search_index
 FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
cte(
    "quoted",
    """SELECT id, CASE WHEN id % 5 = 0 THEN normalized_query || ' "new", cheap' ELSE normalized_query END AS normalized_query,
 "SRPV", "AdClick", revenue, market FROM log_rows""",
    "log_rows",
)
cte(
    "dedup",
    """SELECT theme_pos, theme, keyword, x.b AS brand_pos, x.k AS kw_pos FROM (
 SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS theme_pos, p_brand AS theme, p_name AS keyword,
 min({'b': CAST(p_size AS BIGINT), 'k': p_partkey}) AS x FROM part GROUP BY p_brand, p_name)""",
)
cte(
    "asked",
    """SELECT c_custkey, 'NATION_' || c_nationkey % 5 AS market, lower(c_mktsegment) || ' ' || c_custkey // 8 AS request_key FROM customer""",
)
cte(
    "answered",
    """SELECT 'NATION_' || c_nationkey % 5 AS market, lower(c_mktsegment) || ' ' || c_custkey // 8 AS request_key, arg_max(c_name, c_custkey) AS answer
 FROM customer WHERE c_custkey % 2 = 1 GROUP BY ALL""",
)


def with_ctes(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name not in CTES:
            return
        for need in CTES[name][0]:
            visit(need)
        order.append(name)

    for need in needs:
        visit(need)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order) + "\n" + body


def layout(source: str, market: bool) -> str:
    last = ', market AS "Market"' if market else ""
    return f"""SELECT theme AS "SearchTheme", normalized_query, "Relevance", "SRPV", "AdClick", revenue, "Score",
 matched_keyword, "AI_Valid", "AI_Reason"{last} FROM {source}"""


def joined(column: str, order: str, where: str = "true") -> str:
    return f"coalesce(string_agg({column}, '|' ORDER BY {order}) FILTER (WHERE {where}), '')"


BATCH_LISTS = """SELECT theme_pos, theme, batch_index,
 CAST(to_json(list(normalized_query ORDER BY rank_pos)) AS VARCHAR) AS queries_json, count(*) AS n_queries
 FROM ranked GROUP BY theme_pos, theme, batch_index"""

ORACLE: dict[str, str] = {
    "scan_query_log": with_ctes('SELECT normalized_query, "SRPV", "AdClick", revenue, market FROM quoted', "quoted"),
    "row_id": with_ctes(
        'SELECT row_number() OVER (ORDER BY id) - 1 AS id, normalized_query, "SRPV", "AdClick", revenue, market FROM quoted',
        "quoted",
    ),
    "growing_store": with_ctes(
        f"""SELECT row_number() OVER (ORDER BY id) - 1 AS id, normalized_query, "SRPV", "AdClick", revenue, market,
 {fold(half_clean('normalized_query'))} AS match_text FROM quoted""",
        "quoted",
    ),
    "growing_stats": with_ctes(
        f"""SELECT market, g AS gram, count(*) AS n FROM (
 SELECT market, substring(t, CAST(i AS BIGINT), CAST(s AS BIGINT)) AS g
 FROM (SELECT market, {fold(half_clean('normalized_query'))} AS t FROM quoted), unnest([1, 2, 3]) x(s), unnest(range(1, length(t) - s + 2)) u(i))
 GROUP BY market, g""",
        "quoted",
    ),
    "materialized_log": with_ctes(
        f"""SELECT id, normalized_query, "SRPV", "AdClick", revenue, CASE WHEN id % 2 = 0 THEN '{MARKET}' ELSE 'Japan' END AS market,
 {fold(half_clean('normalized_query'))} AS match_text FROM log_rows""",
        "log_rows",
    ),
    "market_resolve": with_ctes(
        """SELECT c_custkey, a.market, m.market IS NOT NULL AS is_configured, coalesce(code, lower(a.market)) AS code,
 coalesce(languages, 'English') AS languages, coalesce(encoder, 'all-MiniLM-L6-v2') AS encoder,
 coalesce(log_path, 'logs/market=NATION_0') AS log_path, dedicated_table,
 coalesce(search_index, 'keywords-' || lower(a.market)) AS search_index
 FROM (SELECT c_custkey, 'NATION_' || (c_custkey % 30) AS market FROM customer) a LEFT JOIN markets m ON m.market = a.market""",
        "markets",
    ),
    "external_adapter": """SELECT c_custkey AS id, lower(c_mktsegment) || ' ' || lower(c_name) AS normalized_query,
 CAST(floor(abs(c_acctbal)) AS BIGINT) AS "SRPV", CAST(0 AS BIGINT) AS "AdClick", CAST(0 AS DOUBLE) AS revenue,
 n_name AS market FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "external_match": """WITH q AS (SELECT c_custkey AS id, lower(c_mktsegment) AS segment, n_nationkey, n_name FROM customer
  JOIN nation ON n_nationkey = c_nationkey),
 k AS (SELECT n_nationkey AS theme_pos, lower(n_name) AS theme, length(s) AS kw_pos, s AS keyword
  FROM nation, (SELECT DISTINCT lower(c_mktsegment) AS s FROM customer)),
 h AS (SELECT k.*, q.id FROM k JOIN q ON q.n_nationkey = k.theme_pos AND q.segment = k.keyword),
 v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY theme_pos, keyword ORDER BY id) AS rn FROM h) WHERE rn <= 100)
 SELECT theme_pos, theme, kw_pos, keyword, 'hard' AS method, count(*) AS n_hits, CAST(sum(id) AS BIGINT) AS id_sum FROM h GROUP BY ALL
 UNION ALL SELECT theme_pos, theme, kw_pos, keyword, 'vector', count(*), CAST(sum(id) AS BIGINT) FROM v GROUP BY ALL""",
    "market_slice": """SELECT c_custkey AS "Id", 'm' || c_nationkey AS "TargetMarket",
 lower(c_mktsegment) || ' ' || lower(c_name) AS "Query", CAST(floor(abs(c_acctbal)) AS BIGINT) AS "Srpv"
 FROM customer WHERE c_nationkey = 7""",
    "theme_lines": "SELECT p_name AS theme FROM part WHERE p_partkey % 4 <> 2",
    "theme_clean": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || '/' || p_type WHEN 1 THEN p_name || ' / x'
 ELSE p_name END AS raw_input, p_name AS brand FROM part WHERE p_partkey % 5 NOT IN (2, 3)""",
    "vector_build": f"""SELECT '{MARKET}' AS market, vec_id AS id, len(v) AS dim,
 round(sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm,
 round(list_sum(list_transform(v, lambda x: abs(CAST(x AS DOUBLE)))), 4) AS abs_sum
 FROM (SELECT vec_id, list_transform(raw, lambda x: CAST(x / n AS FLOAT)) AS v
  FROM (SELECT vec_id, raw, sqrt(list_sum(list_transform(raw, lambda x: x * x))) AS n
   FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(CAST(x * CAST(vec_id % 3 + 1 AS FLOAT) AS FLOAT) AS DOUBLE)) AS raw FROM embeddings)))""",
    "result_layout": with_ctes(layout("final", True), "final"),
    "clean_text": with_ctes(
        f"SELECT p_partkey, {clean('query')} AS cleaned, length({clean('query')}) AS n_chars FROM spaced", "spaced"
    ),
    "clean_by_market": with_ctes(f"SELECT p_partkey, market, {STORED} AS cleaned FROM spaced", "spaced"),
    "hard_relevance": with_ctes(
        f"SELECT p_partkey, round({relevance('query', 'noun')}, 9) AS relevance FROM spaced", "spaced"
    ),
    "hard_predicate": with_ctes(
        f"""SELECT p_partkey, contains({fold(STORED)}, {half_clean('p_name')}) AS literal_hit,
 contains({fold(STORED)}, pattern) AS literal_pattern_hit, {fold(STORED)} LIKE '%' || pattern || '%' AS wildcard_hit
 FROM (SELECT *, noun[1] || '%' || noun[-2] || '_' AS pattern FROM spaced)""",
        "spaced",
    ),
    "typo_predicate": with_ctes(
        f"""SELECT id, {typo('normalized_query', 'p_name')} AS name_typo, {typo('normalized_query', NOUN)} AS noun_typo
 FROM log_rows JOIN part ON id = p_partkey""",
        "log_rows",
    ),
    "cosine_pairs": with_ctes(
        f"""SELECT e.vec_id, round({DOT}, 9) AS similarity, round(1 - round({DOT}, 9), 9) AS distance
 FROM embeddings e JOIN anchors a ON a.label = e.label""",
        "anchors",
    ),
    "relevance_floor": with_ctes('SELECT theme, normalized_query, "Relevance" FROM results', "results"),
    "hierarchical_ids": """SELECT p_partkey, theme, job_id, job_id || '-t' || pos AS theme_id,
 job_id || '-t' || pos || '-b' || p_size AS batch_id
 FROM (SELECT p_partkey, p_size, substring(sha256(p_brand || '|' || p_type), 1, 8) AS job_id, i - 1 AS pos,
  string_split(p_name, ' ')[i] AS theme FROM part, unnest(range(1, len(string_split(p_name, ' ')) + 1)) u(i))""",
    "utc_text": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events",
    "hard_match": with_ctes(
        f"""SELECT k.theme, kw_pos, keyword, id, normalized_query, "SRPV", 'hard' AS method,
 round({relevance('normalized_query', 'keyword')}, 9) AS relevance FROM kw k JOIN log_rows l
 ON contains({fold(half_clean('normalized_query'))}, {fold(clean('keyword'))})""",
        "kw",
        "log_rows",
    ),
    "hard_match_wildcards": with_ctes(
        f"""SELECT k.theme, kw_pos, k.pattern AS keyword, id, normalized_query, "SRPV", 'hard' AS method,
 round({relevance('normalized_query', 'k.pattern')}, 9) AS relevance
 FROM (SELECT *, w[1] || w[-1][1] || '%' || w[-1][-2] || '_' AS pattern FROM (SELECT *, string_split(keyword, ' ') AS w FROM kw)) k
 JOIN log_rows l ON {fold(half_clean('normalized_query'))} LIKE '%' || {fold(clean('k.pattern'))} || '%'""",
        "kw",
        "log_rows",
    ),
    "hard_match_blocks": with_ctes(
        f"SELECT {HIT_SELECT} FROM ({hard('pair_log', 'pair_samples')})", "pair_log", "pair_samples"
    ),
    "hard_match_text": with_ctes(f"SELECT {HIT_SELECT} FROM pair_hard", "pair_hard"),
    "vector_topk": with_ctes("SELECT * FROM neighbours", "neighbours"),
    "attach_metrics": with_ctes(
        """SELECT theme, keyword, n.id, similarity, normalized_query, "SRPV", "AdClick", revenue
 FROM neighbours n JOIN log_rows l ON l.id = n.id""",
        "neighbours",
        "log_rows",
    ),
    "vector_verify": with_ctes(f"SELECT {HIT_SELECT} FROM verified", "verified"),
    "lexical_topk": with_ctes(
        """, docs AS (SELECT id, list_filter(string_split(lower(normalized_query), ' '), lambda w: length(w) > 0) AS words FROM log),
 tf AS (SELECT id, token, any_value(dl) AS dl, count(*) AS tf FROM (SELECT id, len(words) AS dl, unnest(words) AS token FROM docs)
  GROUP BY id, token),
 totals AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(words)) AS avg_dl FROM docs),
 freq AS (SELECT token, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY token),
 terms AS (SELECT theme, keyword, unnest(list_distinct(string_split(lower(keyword), ' '))) AS token FROM kw),
 scored AS (SELECT theme, keyword, id, round(sum(ln(CAST(1 AS DOUBLE) + (n - df + 0.5) / (df + 0.5)) * tf * CAST(2.2 AS DOUBLE)
  / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avg_dl))), 9) AS score
  FROM terms JOIN freq USING (token) JOIN tf USING (token) CROSS JOIN totals GROUP BY theme, keyword, id),
 best AS (SELECT *, row_number() OVER (PARTITION BY theme, keyword ORDER BY score DESC, id) AS rn FROM scored)
 SELECT theme, keyword, id, round(score, 6) AS score,
 round(round(score / max(score) OVER (PARTITION BY theme, keyword), 9), 6) AS similarity FROM best WHERE rn <= 100""",
        "kw",
        "log",
    ),
    "gram_topk": with_ctes("SELECT theme, keyword, id, normalized_query, similarity FROM near", "near"),
    "typo_join": with_ctes(
        f"SELECT theme, kw_pos, keyword, id, normalized_query, CAST(edits AS INTEGER) AS edits, similarity FROM ({typos('pair_log', 'pair_samples')})",
        "pair_log",
        "pair_samples",
    ),
    "gram_topk_text": with_ctes(
        "SELECT theme, keyword, id, normalized_query, similarity FROM pair_near WHERE similarity >= 0.6", "pair_near"
    ),
    "apply_verdicts": """SELECT doc_id AS theme_pos, source AS normalized_query, coalesce(quality <> 0, true) AS "AI_Valid",
 CASE WHEN quality = 0 THEN 'low quality' ELSE '' END AS "AI_Reason" FROM documents LEFT JOIN labels USING (doc_id)""",
    "job_detail": with_ctes(
        """SELECT t.job_id, j.status AS job_status, t.theme_id,
 t.task_pos, t.theme, t.status,
 t.created_at, b.batch_pos, b.batch_index, b.n_queries
 FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at, theme_id) - 1 AS task_pos FROM tasks) t
 JOIN job_states j ON j.job_id = t.job_id
 LEFT JOIN (SELECT job_id || '-' || event_type AS theme_id, event_id AS batch_index, CAST(floor(value) AS BIGINT) AS n_queries,
  row_number() OVER (PARTITION BY job_id, event_type ORDER BY event_id) - 1 AS batch_pos
  FROM events_in_jobs) b ON b.theme_id = t.theme_id""",
        "tasks",
        "job_states",
    ),
    "pending_requests": with_ctes(
        """SELECT DISTINCT a.market, a.request_key FROM asked a
 WHERE NOT EXISTS (SELECT 1 FROM answered b WHERE b.market = a.market AND b.request_key = a.request_key)""",
        "asked",
        "answered",
    ),
    "reused_requests": with_ctes(
        "SELECT a.c_custkey, a.market, a.request_key, b.answer FROM asked a JOIN answered b USING (market, request_key)",
        "asked",
        "answered",
    ),
    "merge_hits": with_ctes("SELECT * FROM merged", "merged"),
    "matched_keyword": with_ctes("SELECT theme, normalized_query, matched_keyword FROM merged", "merged"),
    "score_distribution": with_ctes(
        'SELECT theme, "Score", count(*) AS n_queries FROM results GROUP BY theme, "Score"', "results"
    ),
    "hits_per_keyword": with_ctes(
        """SELECT k.theme_pos, k.theme, k.kw_pos, k.keyword, count(*) FILTER (WHERE method = 'hard') AS hard_hits,
 count(*) FILTER (WHERE method = 'vector') AS vector_hits FROM kw k LEFT JOIN hits h USING (theme_pos, kw_pos) GROUP BY ALL""",
        "hits",
        "kw",
    ),
    "run_metrics": with_ctes(
        """SELECT '0badcafe' AS job_id, CAST(step_no AS INTEGER) AS step_no, step, 'done' AS status, rows, hard, vector, valid, true AS timed FROM (
 SELECT 0 AS step_no, 'keywords' AS step, count(*) AS rows, NULL::BIGINT AS hard, NULL::BIGINT AS vector, NULL::BIGINT AS valid FROM kw
 UNION ALL SELECT 1, 'hits', count(*), count(*) FILTER (method = 'hard'), count(*) FILTER (method = 'vector'), NULL FROM hits
 UNION ALL SELECT 2, 'keyword_hits', (SELECT count(*) FROM kw), count(*) FILTER (method = 'hard'), count(*) FILTER (method = 'vector'), NULL FROM hits
 UNION ALL SELECT 3, 'results', count(*), NULL, NULL, NULL FROM results
 UNION ALL SELECT n, s, (SELECT count(*) FROM (SELECT DISTINCT theme_pos, batch_index FROM ranked)), NULL, NULL, NULL
  FROM (VALUES (4, 'requests'), (5, 'replies')) v(n, s)
 UNION ALL SELECT 6, 'final', count(*), NULL, NULL, count(*) FILTER (length(normalized_query) % 2 = 0) FROM results)""",
        "kw",
        "hits",
        "results",
        "ranked",
    ),
    "observed_hits": with_ctes(
        """SELECT k.theme_pos, k.theme, k.kw_pos, k.keyword, count(*) FILTER (WHERE method = 'hard') AS hard_hits,
 count(*) FILTER (WHERE method = 'vector') AS vector_hits FROM kw k LEFT JOIN hits h USING (theme_pos, kw_pos) GROUP BY ALL""",
        "hits",
        "kw",
    ),
    "timed_tasks": with_ctes(
        """SELECT '0badcafe' AS job_id, theme_pos, 'done' AS status, n_keywords, count(normalized_query) AS match_count,
 count(*) FILTER (WHERE length(normalized_query) % 2 = 0) AS valid_count, count(*) FILTER (WHERE length(normalized_query) % 2 = 1) AS invalid_count,
 true AS timed FROM (SELECT theme_pos, count(*) AS n_keywords FROM kw GROUP BY ALL) k LEFT JOIN results USING (theme_pos) GROUP BY ALL""",
        "kw",
        "results",
    ),
    "floor_removed": with_ctes(
        """SELECT theme, count(*) AS merged_rows, count(*) FILTER (WHERE "Relevance" < 0.4) AS removed_rows
 FROM merged GROUP BY theme""",
        "merged",
    ),
    "theme_counts": with_ctes(
        """SELECT k.theme_pos, k.theme, k.market, count(normalized_query) AS match_count, count(*) FILTER (WHERE "AI_Valid") AS valid_count,
 count(*) FILTER (WHERE NOT "AI_Valid") AS invalid_count FROM (SELECT DISTINCT theme_pos, theme, market FROM kw) k
 LEFT JOIN final f USING (theme_pos) GROUP BY ALL""",
        "final",
        "kw",
    ),
    "batch_counts": with_ctes(
        """SELECT theme, batch_index, count(*) FILTER (WHERE "AI_Valid") AS valid_count,
 count(*) FILTER (WHERE NOT "AI_Valid") AS invalid_count FROM ranked GROUP BY theme, batch_index""",
        "ranked",
    ),
    "job_status": with_ctes("SELECT * FROM job_states", "job_states"),
    "theme_task_row": with_ctes(
        """SELECT theme_pos, theme, 'keyword' AS list, kw_pos AS pos, keyword AS item, CAST(NULL AS BOOLEAN) AS valid FROM kw
 UNION ALL SELECT theme_pos, theme, 'query', rank_pos, normalized_query, "AI_Valid" FROM ranked""",
        "ranked",
        "kw",
    ),
    "theme_rollup": with_ctes(
        """SELECT k.theme_pos, k.theme AS "SearchTheme", k.market, CAST(coalesce(sum("SRPV"), 0) AS BIGINT) AS "SRPV",
 CAST(coalesce(sum("AdClick"), 0) AS BIGINT) AS "AdClick", coalesce(round(sum(revenue), 2), 0) AS revenue,
 CAST(coalesce(sum("SRPV") FILTER (WHERE "AI_Valid"), 0) AS BIGINT) AS "valid_SRPV",
 CAST(coalesce(sum("AdClick") FILTER (WHERE "AI_Valid"), 0) AS BIGINT) AS "valid_AdClick",
 round(coalesce(sum(revenue) FILTER (WHERE "AI_Valid"), 0), 2) AS valid_revenue
 FROM (SELECT DISTINCT theme_pos, theme, market FROM kw) k LEFT JOIN final f USING (theme_pos) GROUP BY k.theme_pos, k.theme, k.market""",
        "final",
        "kw",
    ),
    "timing_summary": with_ctes(
        """SELECT status, count(*) AS n_tasks, CAST(sum(match_count) AS BIGINT) AS match_count,
 round(sum(elapsed_sec), 2) AS elapsed_sec FROM tasks GROUP BY status""",
        "tasks",
    ),
    "validation_chunks": with_ctes("SELECT theme, normalized_query, rank_pos, batch_index FROM ranked", "ranked"),
    "dedup_keywords": with_ctes("SELECT * FROM dedup", "dedup"),
    "ranked_results": with_ctes(
        'SELECT theme, rank_pos, normalized_query, "Score", "Relevance", "SRPV" FROM ranked', "ranked"
    ),
    "recent_jobs": with_ctes(
        """SELECT job_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS finished_at
 FROM events_in_jobs GROUP BY job_id ORDER BY created_at DESC, job_id LIMIT 50""",
        "events_in_jobs",
    ),
    "preview_lists": with_ctes(
        f"""SELECT k.theme, {joined('normalized_query', 'rank_pos', 'rank_pos < 50')} AS preview,
 greatest(count(normalized_query) - 50, 0) AS n_more FROM (SELECT DISTINCT theme_pos, theme FROM kw) k
 LEFT JOIN ranked r USING (theme_pos) GROUP BY k.theme_pos, k.theme""",
        "ranked",
        "kw",
    ),
    "concat_runs": with_ctes(
        f"""{layout('final', False)} UNION ALL BY NAME SELECT theme AS "SearchTheme", normalized_query, "Relevance", "SRPV",
 "AdClick", revenue, "Score", matched_keyword FROM results""",
        "final",
    ),
    "keyword_guard": with_ctes(
        f"""SELECT theme_pos, theme, keyword FROM (
 SELECT theme_pos, theme, normalized_query AS keyword FROM brand_queries
 UNION ALL SELECT -1, brand, parent FROM brands WHERE parent IS NOT NULL) k JOIN brands b ON b.brand = k.theme
 WHERE (NOT common OR (contains({clean('keyword')}, theme) AND NOT list_has_any(string_split(keyword, ' '), terms)))
 AND {clean('keyword')} IS DISTINCT FROM parent""",
        "brand_queries",
        "brands",
    ),
    "keyword_cap": with_ctes(
        """SELECT theme, keyword, kw_pos FROM (SELECT *, row_number() OVER (PARTITION BY theme_pos
 ORDER BY length(keyword), kw_pos, keyword) AS rn FROM dedup) WHERE rn <= 15""",
        "dedup",
    ),
    "rule_labels": with_ctes(
        f"SELECT theme_pos, theme, normalized_query, {REASON} = '' AS is_valid, {REASON} AS reason FROM flagged_queries",
        "flagged_queries",
    ),
    "language_plan": with_ctes(
        """SELECT market, english_only, languages AS language_list, primary_language,
 CASE WHEN english_only THEN CAST(1 AS BIGINT) ELSE 2 END AS n_languages FROM markets""",
        "markets",
    ),
    "expansion_requests": with_ctes(
        """SELECT p_partkey AS theme_pos, 'NATION_' || (p_partkey % 30) AS market,
 'List up to 15 short search keywords for the brand or product "' || p_name || '" as people in NATION_' || (p_partkey % 30)
 || ' would type them. ' || CASE WHEN coalesce(english_only, true) THEN 'Write every keyword in English.'
 ELSE 'Write keywords in ' || languages || '. Put ' || primary_language || ' first and add English forms of international names.' END
 || ' Answer with a JSON array of strings and nothing else.' AS request
 FROM part LEFT JOIN markets ON market = 'NATION_' || (p_partkey % 30)""",
        "markets",
    ),
    "validation_requests": with_ctes(
        f"SELECT theme, batch_index, queries_json, n_queries FROM ({BATCH_LISTS})", "ranked"
    ),
    "expansion_replies": with_ctes(
        """SELECT theme, brand_pos, kw_pos, keyword FROM kw, (VALUES (CAST(0 AS BIGINT)), (1), (2)) b(brand_pos)
 UNION ALL SELECT DISTINCT theme, brand_pos, CAST(0 AS BIGINT), theme FROM kw, (VALUES (CAST(3 AS BIGINT)), (4), (5)) b(brand_pos)""",
        "kw",
    ),
    "validation_replies": with_ctes(
        """SELECT theme_pos, normalized_query, arg_max(is_valid, batch_index) AS is_valid, arg_max(reason, batch_index) AS reason
 FROM batch_verdicts WHERE batch_index % 4 <> 3 GROUP BY theme_pos, normalized_query""",
        "batch_verdicts",
    ),
    "verdict_defaults": f"""SELECT u.conv_id AS theme_pos, u.turn AS batch_index,
 u.text AS normalized_query,
 NOT (a.turn IS NOT NULL AND u.conv_id % 5 = 0) AS is_valid,
 CASE WHEN a.turn IS NULL THEN '{API_REASON}' WHEN u.conv_id % 5 = 0 THEN 'off brand'
 WHEN u.conv_id % 5 = 1 THEN '{EMPTY_REASON.format('length')}' WHEN u.conv_id % 5 = 2 THEN '{PARSE_REASON}'
 WHEN u.conv_id % 5 = 3 THEN '{API_REASON}' ELSE '{EMPTY_REASON.format('content_filter')}' END AS reason
 FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
 WHERE u.role = 'user'""",
    "space_variants": with_ctes(
        f"""SELECT p_partkey, market, query AS keyword FROM spaced
 UNION SELECT p_partkey, market, replace(query, ' ', '{FULL_SPACE}') FROM spaced WHERE market = 'Japan'
 UNION SELECT p_partkey, market, replace(query, '{FULL_SPACE}', ' ') FROM spaced WHERE market = 'Japan'""",
        "spaced",
    ),
    "history_json": with_ctes(
        f"""SELECT '0badcafe-t' || q.theme_pos || '-b' || q.batch_index AS batch_id, q.queries_json AS queries, q.n_queries, v.n_results
 FROM ({BATCH_LISTS}) q JOIN (SELECT theme_pos, batch_index, count(*) AS n_results FROM batch_verdicts GROUP BY ALL) v
 ON v.theme_pos = q.theme_pos AND v.batch_index = q.batch_index""",
        "ranked",
        "batch_verdicts",
    ),
    "run_batches": with_ctes(
        f"""SELECT '0badcafe-t' || v.theme_pos AS theme_id, '0badcafe-t' || v.theme_pos || '-b' || v.batch_index AS batch_id,
 'done' AS status, q.n_queries, v.normalized_query, v.is_valid, v.reason
 FROM batch_verdicts v JOIN ({BATCH_LISTS}) q ON v.theme_pos = q.theme_pos AND v.batch_index = q.batch_index""",
        "ranked",
        "batch_verdicts",
    ),
    "run_tasks": with_ctes(
        """SELECT '0badcafe' AS job_id, '0badcafe-t' || k.theme_pos AS theme_id, k.theme_pos, k.theme, k.market, 'done' AS status, k.n_keywords,
 count(normalized_query) AS match_count, count(*) FILTER (WHERE "AI_Valid") AS valid_count,
 count(*) FILTER (WHERE NOT "AI_Valid") AS invalid_count
 FROM (SELECT theme_pos, theme, market, count(*) AS n_keywords FROM kw GROUP BY ALL) k LEFT JOIN judged j USING (theme_pos) GROUP BY ALL""",
        "judged",
        "kw",
    ),
    "vector_graph_topk": with_ctes(
        """SELECT 'vector ' || vec_id AS keyword, least(16 * (SELECT count(*) FROM embeddings), 20) AS n_exact, true AS enough, true AS few
 FROM asked_vectors""",
        "asked_vectors",
    ),
    "vector_topk_lsh": with_ctes(
        """SELECT 'vector ' || vec_id AS keyword, count(*) FILTER (WHERE similarity >= 0.8) AS n_exact, true AS found, true AS exact
 FROM (SELECT a.vec_id, list_inner_product(CAST(a.anchor AS DOUBLE[]), list_transform(range(1, len(e.embedding) + 1), lambda i:
   CAST(e.embedding[i] AS DOUBLE) * cos(t * CAST(0.2 AS DOUBLE))
   + CASE WHEN i % 2 = 1 THEN -CAST(e.embedding[i + 1] AS DOUBLE) ELSE CAST(e.embedding[i - 1] AS DOUBLE) END * sin(t * CAST(0.2 AS DOUBLE)))) AS similarity
  FROM embeddings e, asked_vectors a, unnest(range(0, 4)) u(t)) GROUP BY vec_id""",
        "asked_vectors",
    ),
    "flagship_vectors": with_ctes("SELECT * FROM vector_results", "vector_results"),
    "stream_theme_matches": with_ctes("SELECT * FROM results", "results"),
    "stream_jobs": with_ctes(
        """SELECT job_id, CASE WHEN failed > 0 OR job_id = 'job-1' THEN 'error' ELSE 'complete' END AS type,
 n + CASE WHEN job_id = 'job-1' THEN 1 ELSE 0 END AS n_themes, n - failed AS done, failed, match_count, n + 2 AS n_lines
 FROM (SELECT 'job-' || abs(t.theme_pos) % 3 AS job_id, count(*) AS n, count(*) FILTER (WHERE length(theme) = 4) AS failed,
  CAST(coalesce(sum(m.c) FILTER (WHERE length(theme) <> 4), 0) AS BIGINT) AS match_count
  FROM (SELECT DISTINCT theme_pos, theme FROM kw) t LEFT JOIN (SELECT theme_pos, count(*) AS c FROM results GROUP BY theme_pos) m
  ON m.theme_pos = t.theme_pos GROUP BY ALL)""",
        "kw",
        "results",
    ),
    "progress_events": with_ctes(
        """SELECT CAST(-4611686018427387904 AS BIGINT) AS event_pos, 'job_start' AS type, '{"type":"job_start","job_id":"0badcafe"}' AS line
 UNION ALL SELECT k.theme_pos, 'theme_result',
 '{"type":"theme_result","data":{"theme":"' || k.theme || '","expanded_keywords":' || k.words || ',"match_count":' || coalesce(f.n, 0) || '}}'
 FROM (SELECT theme_pos, theme, CAST(to_json(list(keyword ORDER BY kw_pos)) AS VARCHAR) AS words FROM kw GROUP BY theme_pos, theme) k
 LEFT JOIN (SELECT theme_pos, count(*) AS n FROM final GROUP BY theme_pos) f ON f.theme_pos = k.theme_pos
 UNION ALL SELECT 4611686018427387904, 'complete', '{"type":"complete","job_id":"0badcafe"}'""",
        "final",
        "kw",
    ),
    "flagship_match": with_ctes(
        layout("judged", False).replace(
            " FROM judged",
            """, row_number() OVER (ORDER BY theme_pos, "Score" DESC, "Relevance" DESC, "SRPV" DESC, normalized_query) - 1 AS row_no FROM judged""",
        ),
        "judged",
    ),
    "flagship_text": with_ctes("SELECT * EXCLUDE (market, revenue) FROM pair_results", "pair_results"),
}
ORACLE["hard_match_indexed"] = ORACLE["hard_match"]
for _rule, _flag in [
    ("label_identity", "no_identity"),
    ("label_residual_brand", "other_brand"),
    ("label_comparison", "comparison"),
    ("label_off_topic", "off_topic"),
]:
    ORACLE[_rule] = with_ctes(f"SELECT theme_pos, theme, normalized_query, {_flag} FROM flagged_queries", "flagged_queries")
