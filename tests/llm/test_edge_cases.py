"""Nulls, empty and very long texts, repeated rows, empty tables and extra columns, for every
operator and stage."""

import base64
import hashlib
import random
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest

from themelift.llm import boosted_trees, bpe, html_extract, packing, quality_rules, simhash, substring, topk, toxicity, warc
from themelift.llm.queries import ORACLE, vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, n_words string, kept int, `odd name` struct<`a b`:int>"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))


def documents(spark):
    random.seed(5)
    words = ["alpha", "beta", "gamma", "delta", "Über", "x,", "ß", "日本", "a" * 4000]
    rows = [(i, " ".join(random.choices(words, k=random.randint(1, 80)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, LONG), (104, LONG), (105, "\n\n\n"), (None, "alpha beta"), (None, None)]
    rows += [rows[3], rows[3], (3, "another text with this id " * 30)]
    return spark.createDataFrame([(i, t, None, "s", 1, 0.5, 7, "n", None, (1,)) for i, t in rows], DOCS)


def labels(spark, rows=None):
    if rows is None:
        rows = [(i, i % 3 and 1, i % 2) for i in range(50)] + [(None, 1, 0), (5, None, None), (6, 1, 1), (6, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def none_of(df):
    return df.where("false")


DOCUMENT_OPERATORS = {
    "quality_rules": lambda d, n: quality_rules.ledger(d),
    "trees": lambda d, n: boosted_trees.classify(d, n),
    "simhash": lambda d, n: simhash.near_copies(d),
    "passages": lambda d, n: substring.remove_passages(d),
    "toxicity": lambda d, n: toxicity.classify(d, n),
    "tokens": lambda d, n: bpe.token_digests(d, vocabulary_path()),
}


@pytest.mark.parametrize("name", DOCUMENT_OPERATORS)
def test_one_row_for_each_document(spark, name):
    docs, known = documents(spark), labels(spark)
    want = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in DOCUMENT_OPERATORS[name](docs, known).collect())
    assert got == want
    assert DOCUMENT_OPERATORS[name](none_of(docs), known).collect() == []


@pytest.mark.parametrize("name", ["trees", "toxicity"])
@pytest.mark.parametrize("rows", [[], [(1, 1, 1), (2, 1, 1)], [(None, None, None)]])
def test_without_labels_of_both_classes(spark, name, rows):
    scores = {r.score for r in DOCUMENT_OPERATORS[name](documents(spark), labels(spark, rows)).collect()}
    assert len(scores) == 1 and all(0 <= s <= 1 for s in scores)


@pytest.mark.parametrize("name, step", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, tmp_path, name, step):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark)
    out = step(spark, docs, str(tmp_path))
    assert step(spark, none_of(docs), str(tmp_path)).collect() == []
    if name == "packing":
        assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
        return
    assert out.dtypes == docs.dtypes
    rows = {tuple(r[k] for k in ("lang", "source", "score", "id", "n_words", "kept")) for r in out.collect()}
    assert rows <= {(None, "s", 0.5, 7, "n", None)}


def test_packing_of_odd_texts(spark):
    docs = documents(spark)
    rows = packing.pack_documents(docs, vocabulary_path()).collect()
    assert sum(r.length for r in rows if r.doc_id in (100, 101, 102, 105)) == 4
    assert sum(r.length for r in rows if r.doc_id == 103) == next(r.doc_tokens for r in rows if r.doc_id == 103)
    assert packing.pack_documents(none_of(docs), vocabulary_path()).collect() == []


PAGES = "page_id long, url string, html string, text string, n_chars long, record_type string"


def pages(spark):
    body = "<article><p>Some text, here.</p></article>"
    rows = [(1, "u", body), (2, None, body), (3, "u\r\nX: y", body), (4, "u", None), (5, "u", ""), (6, "u", "x" * 300_000)]
    rows += [(7, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb\n"), (8, "u", "ü日\x00"), (9, "u", "ü日\x00"), (9, "u", "ü日\x00")]
    return spark.createDataFrame([(*r, "t", 3, "z") for r in rows], PAGES)


def test_archives(spark):
    table = pages(spark)
    path = warc.archive(table)
    got = {}
    for r in warc.page_records(spark, path).collect():
        got.setdefault(r.page_id, []).append((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to))
    raw = {r.page_id: (r.html or "").encode() for r in table.collect()}
    for page, payload in raw.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        last = max(p for p, x in raw.items() if x == payload)
        own = (len(payload), digest, *(("response", None) if page == last else ("revisit", last)))
        assert own in got[page]
    assert sorted(x[2:] for x in got[9]) == [("response", None), ("revisit", 9)]
    stored = {r.page_id: bytes(r.payload) for r in warc.read_archives(spark, path, payloads=True).where("record_type = 'response'").collect()}
    assert all(stored[p] == raw[p] for p in stored) and 7 in stored
    large = warc.page_records(spark, warc.archive(table, least=1)).where("payload_bytes = 0")
    assert {r.record_type for r in large.collect()} == {"response"}


def test_archives_of_no_pages(spark):
    assert warc.page_records(spark, warc.archive(none_of(pages(spark)))).collect() == []


def test_main_text_rows(spark):
    rows = {r.page_id: r for r in html_extract.extract(pages(spark)).collect()}
    assert rows[1].text == "Some text, here." and rows[4].text == rows[5].text == "" and rows[2].url is None
    assert rows[6].n_chars == 300_000
    assert html_extract.extract(none_of(pages(spark))).collect() == []


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [0.5, 0.5]), (7, [0.5, 0.5]), (8, [1.0]), (None, [1.0, 1.0]), (50, [-1.0, -0.001])]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, label int, score double")
    v = topk.integer_vectors(table)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v, v.where("id % 50 = 0")).collect()]
    assert sorted(got) == [
        (0, 1, 6, 256 * 128 + 128 * 128), (0, 2, 7, 256 * 128 + 128 * 128), (0, 3, 50, -256 * 256 - 128),
        (50, 1, 6, -256 * 128 - 128), (50, 2, 7, -256 * 128 - 128), (50, 3, 0, -256 * 256 - 128),
    ]
    assert topk.top_k(none_of(v), none_of(v)).collect() == []


SENTENCE = "A sentence of the text, with several words, and marks; it goes on, and on. "
PARAGRAPH = f"<p>{SENTENCE * 4}</p>"


def test_path_ratios_decide_inside_articles():
    links = "".join(f"<div class=x><a href=#>Other story number {k}, with a headline</a></div>" for k in range(5))
    labels = "".join(f"<span><div class=y>t{k}</div></span>" for k in range(12))
    got = html_extract.main_text(f"<article><h1>Headline</h1>{PARAGRAPH}{links}{PARAGRAPH}<ul><li>one</ul>{PARAGRAPH}{labels}</article>").split("\n")
    assert got == ["Headline", *[(SENTENCE * 4).strip()] * 2, "one", (SENTENCE * 4).strip()]


def test_headline_and_lead_before_the_article():
    got = html_extract.main_text(f"<main><h1>Headline</h1><p>A lead, of some words.</p><article>{PARAGRAPH}</article></main>")
    assert got.split("\n")[:2] == ["Headline", "A lead, of some words."] and SENTENCE.strip() in got


def test_text_beside_a_teaser_article():
    got = html_extract.main_text(f"<div class=x>{PARAGRAPH * 4}</div><article class=y><p>Teaser</p></article>")
    assert got.count("A sentence") == 16


def test_top_k_of_repeated_rows(spark, tmp_path):
    random.seed(3)
    rows = [(i, [random.randint(-8, 8) / 16 for _ in range(4)]) for i in range(130)]
    rows += [rows[7]] * 4 + [rows[50]] + [rows[100]] * 6 + [(0, [0.5, 0.5, 0.0, 0.25]), (9, [1.0, 1.0, 1.0, 1.0])] + [(8, [1.0, 1.0, 1.0, 1.0])] * 5
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = db.execute(ORACLE["op6_exact_top_k"]).fetchall()
    v = topk.integer_vectors(table)
    for tiles in ({}, {"tile_queries": 2, "tile_vectors": 11}):
        got = topk.top_k(v, v.where("id % 50 = 0"), **tiles).select("query_id", "rank", "vec_id", "score").collect()
        assert sorted(map(tuple, got)) == sorted(want) and len(got) == 15


def test_ratios_of_grams_are_not_shared(spark):
    words = [bytes(random.Random(k).choices(b"abcdefghijklmnop", k=6)) for k in range(30_000)]
    keys = np.array([int.from_bytes(w, "big") for w in words])
    slots = toxicity.slot_of(keys, 1 << 23)
    order = np.argsort(slots, kind="stable")
    a, b = next((x, y) for x, y in zip(order, order[1:]) if slots[x] == slots[y] and keys[x] != keys[y])
    grams = spark.createDataFrame([(int(keys[a]), 8.0), (int(keys[b]), -4.0)], "gram long, ratio double")
    contexts = spark.createDataFrame([(int(keys[a]) >> 8, 2.0)], "context long, ratio double")
    texts = [words[a], words[b], words[a][:5] + b"z", words[a] + b" x " + words[a].upper(), None, b" "]
    docs = spark.createDataFrame([(k, t and t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    want = {0: 8 / 7, 1: -4 / 7, 2: 2 / 7, 3: 16 / 16, 4: 0, 5: 0}
    for limit in (1 << 20, 0):
        model = toxicity.model_of(grams, contexts, limit)
        assert (model.arrays is None) == (limit == 0)
        got = {r.doc_id: r._whole for r in toxicity.described(docs, model).collect()}
        assert got == pytest.approx(want)


def test_toxicity_by_joins_equals_broadcast(spark, monkeypatch):
    docs, known = documents(spark), labels(spark)
    key = lambda r: (r.doc_id is None, r.doc_id, r.score)
    want = sorted(toxicity.classify(docs, known).collect(), key=key)
    monkeypatch.setattr(toxicity, "model_of", lambda g, c, make=toxicity.model_of: make(g, c, 0))
    got = sorted(toxicity.classify(docs, known).collect(), key=key)
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    assert [r.score for r in got] == pytest.approx([r.score for r in want])


def test_every_label_is_counted(spark):
    rest = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 == 4]
    others = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)]
    bad = {i: "zugqwix" for i in rest[:40]} | {i: "vondrek" for i in others[:60]}
    rows = [(i, f"plain words of the text {bad.get(i, 'more')} and others") for i in rest[:200] + others[:400]]
    docs = spark.createDataFrame([*rows, (9001, "plain words of the text zugqwix and others")], "doc_id long, text string")
    known = spark.createDataFrame([(i, 1, int(i in bad)) for i, _ in rows], "doc_id long, quality int, toxic int")
    counts = toxicity.gram_counts(docs, boosted_trees.labelled(known, "toxic"), known.where("false"))
    gram, _ = toxicity.grams_of([b"zugqwix"])
    assert counts.where("c1 > 0").where(counts.gram.isin(gram.tolist())).count() == len(gram)
    model, _ = toxicity.learn(docs, known)
    found = {r.gram: r.ratio for r in model.grams.collect()}
    assert sum(found.get(int(g), 0.0) for g in gram) > 2


@pytest.mark.parametrize(
    "part",
    ["<svg width='1'/>", "<svg><path d='x'/><text>no</text></svg>", "<math/>", "<object data='x'/>", "<select><option>no", "<select><option>no</select>",
     "<svg><title/><path/>", "<template><p>no</p></template>", "<object data=x>", "<svg><path>"],
)
def test_text_after_embedded_parts(part):
    assert html_extract.main_text(f"<article><p>Some text, before.{part}</p><p>And more, after it.</p></article>") == "Some text, before.\nAnd more, after it."


def test_text_of_formulas_and_fallbacks():
    page = "<article><p>Let <math><mi>x</mi></math> be, <object data=x>a fallback</object> here.</p></article>"
    assert html_extract.main_text(page) == "Let x be, a fallback here."


@pytest.mark.parametrize(
    "start, end",
    [
        ("<article class='post has-sidebar'>", "</article>"),
        ("<article class='post comments-open' id=x>", "</article>"),
        ("<div class='container has-sidebar'><article>", "</article></div>"),
        ("<article><div class='elementor-widget elementor-widget-text-editor'><div class='elementor-widget-container'>", "</div></div></article>"),
    ],
)
def test_listed_words_of_content_parts(start, end):
    side = f"<div class=sidebar>{PARAGRAPH}</div><div class='ad'>Buy, now, and here.</div>"
    got = html_extract.main_text(f"<body>{start}<h1>Headline</h1>{PARAGRAPH * 3}{side}{end}</body>").split("\n")
    assert got == ["Headline", *[(SENTENCE * 4).strip()] * 3]


def test_short_lists_and_quotes_between_paragraphs():
    page = f"<body><div class=x><h1>Headline</h1>{PARAGRAPH * 10}<ul><li>one<li>two<li>three</ul><blockquote>so</blockquote>{PARAGRAPH * 10}</div></body>"
    got = html_extract.main_text(page).split("\n")
    assert got[0] == "Headline" and got[11:15] == ["one", "two", "three", "so"] and len(got) == 25


def test_near_copies_of_repeated_ids(spark):
    a, b, c, d = (" ".join(random.Random(k).choices([f"{k}w{i}" for i in range(400)], k=200)) for k in range(4))
    rows = [(2, b), (3, a), (3, b), (4, a), (5, c), (5, d), (5, d), (6, d), (None, c)]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.doc_id or 0, [a, b, c, d].index(r.text)) for r in out)
    assert got == [(0, 2), (2, 1), (3, 0), (5, 2), (5, 3)]
