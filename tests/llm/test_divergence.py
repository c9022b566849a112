"""Source divergence against a plain count of every term, and the parts of the pair tasks."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare, connect

from themelift.llm import divergence as d
from themelift.llm.queries import ORACLE, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, value string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=3, top=200):
    langs, groups, df, count = set(), set(), Counter(), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        langs.add(lang)
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        df.update({(lang, t) for t in terms})
        count[lang, source].update(terms)
    kept = {g: sorted(t for x, t in df if x == g and df[x, t] >= least) for g in langs}
    out = []

    def price(c, n, v):
        return 1 + 10**9 * (c + 1) // (n + v)

    for lang, source in groups:
        terms, others = kept[lang], sorted(s for x, s in groups if x == lang)
        n = {s: sum(count[lang, s][t] for t in terms) for s in others}
        v, n_lang = len(terms), sum(n.values())
        p = {s: [price(count[lang, s][t], n[s], v) for t in terms] for s in others}
        pairs = [(-sum((a - b) ** 2 // b for a, b in zip(p[source], p[s], strict=True)), s.encode(), s) for s in others if s != source]
        own = []
        for t, a in zip(terms, p[source], strict=True):
            b = price(sum(count[lang, s][t] for s in others), n_lang, v)
            if count[lang, source][t] and a > b:
                own.append((-((a - b) ** 2 // b), t.encode(), t))
        for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
            out += [(lang, source, part, item, -value, k) for k, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def made(seed, n, words=60, sources=7):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("x", "É", "ß", "日", "Q", "zz") for b in "abcdefghij"][:words] + ["the", "THE"]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(vocabulary[: rng.randrange(1, len(vocabulary))]) + rng.choice(["", "1", "-", "7x"]) for _ in range(rng.randrange(30)))
        rows.append((k, rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "de", None, "no"]), rng.choice([f"s{i}" for i in range(sources)] + [None]), "v"))
    return rows + [(None, "only once here", "xx", "s1", None), (1, None, "empty", "a", None), (1, None, "empty", "b", None)]


@pytest.mark.parametrize(("stretch", "block"), [(1 << 15, 10), (5, 2), (1, 1)])
def test_equals_plain_counts(spark, stretch, block):
    rows = made(stretch, 150)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in d.divergence(docs, stretch=stretch, block=block).collect())
    assert got == plain(rows)


def test_sql_with_nulls_and_limits(spark, tmp_path):
    rows = made(9, 120)
    rng = random.Random(3)
    many = ["".join(rng.choice("abcdefghijkl") for _ in range(4)) for _ in range(700)]
    rows += [(k, " ".join(many[k % 3 :: 2]), "big", f"s{k % 2}", None) for k in range(12)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES["op13_source_divergence"](spark, str(tmp_path))
    assert compare(df, con, ORACLE["op13_source_divergence"]) == ""
    assert df.where("part = 'term'").groupBy("lang", "source").count().agg({"count": "max"}).first()[0] == 200
    assert compare(d.divergence(spark.createDataFrame(rows, SCHEMA), top=10**6, stretch=64, block=1).where("rank <= 200 or part = 'pair'"), con, ORACLE["op13_source_divergence"]) == ""


def test_empty_table(spark):
    assert d.divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_gallop():
    rng = np.random.default_rng(1)
    for _ in range(300):
        needles = np.unique(rng.integers(0, 400, rng.integers(0, 90)))
        among = np.unique(rng.integers(0, 400, rng.integers(0, 300)))
        assert d.gallop(needles, among).tolist() == np.searchsorted(among, needles).tolist()
        long = np.unique(rng.integers(0, 10**6, 5000))
        assert d.gallop(long[::97] + 1, long).tolist() == np.searchsorted(long, long[::97] + 1).tolist()


def test_prices_of_large_totals():
    totals = [0, 1, 7, 10**9, 9 * 10**15 - 1]
    for total in totals:
        counts = np.array(sorted({0, min(1, total), total // 3, total}))
        want = [1 + 10**9 * (c + 1) // (total + 5) for c in counts.tolist()]
        assert d.prices(counts, total, 5).tolist() == want


def test_column_prices(spark):
    rows = [(c, t, v) for t in (0, 5, 10**12, 9 * 10**15 - 9) for c in {0, t // 7, t} for v in (1, 8)]
    got = spark.createDataFrame(rows, "c long, t long, v long").select(d.price(*(d.F.col(x) for x in "ctv")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 1) // (t + v) for c, t, v in rows]


def test_no_cross_join(spark):
    plan = d.divergence(spark.createDataFrame(made(2, 30), SCHEMA))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
