"""Each stage of the pipeline on a small table whose surviving rows are known."""

import random

import pytest

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], SCHEMA)


def labelled(spark, tmp_path, column, bad):
    rows = [(i, int(not b) if column == "quality" else 1, int(b) if column == "toxic" else 0) for i, b in bad.items()]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.mark.parametrize(("name", "column"), [("quality classifier", "quality"), ("toxicity", "toxic")])
def test_bad_documents_go_and_clean_ones_stay(spark, tmp_path, name, column):
    rng = random.Random(4)
    bad = {i: i % 4 == 0 for i in range(400)}
    harm = {"quality": lambda: "!! $$ BUY|| ## " * 40, "toxic": lambda: prose(rng, 60) + " grubbfink you zzorkel " + prose(rng, 5)}[column]
    docs = table(spark, [(i, harm() if b else prose(rng, 80)) for i, b in bad.items()])
    labelled(spark, tmp_path, column, bad)
    assert ids(STAGES[name](spark, docs, str(tmp_path))) == [i for i, b in bad.items() if not b]


def test_one_of_each_group_stays(spark, tmp_path):
    rng = random.Random(6)
    text, near, other = prose(rng, 400), "", prose(rng, 400)
    words = text.split()
    words[200] = "changed"
    near = " ".join(words)
    docs = table(spark, [(9, text), (3, near), (5, other), (7, text.upper()), (2, ""), (8, None), (4, "\n ")])
    assert ids(STAGES["SimHash near-dedup"](spark, docs, str(tmp_path))) == [2, 3, 5]


def test_passages_go_from_later_documents(spark, tmp_path):
    rng = random.Random(7)
    passage, own, more = prose(rng, 55), prose(rng, 30), prose(rng, 40)
    docs = table(spark, [(1, f"{own}\n{passage}"), (2, f"{passage}  {more}"), (3, None), (4, "a  b")])
    rows = {r.doc_id: (r.text, r.n_chars) for r in STAGES["substring dedup"](spark, docs, str(tmp_path)).collect()}
    assert rows == {1: (f"{own}\n{passage}", len(own) + 1 + len(passage)), 2: (more, len(more)), 3: (None, None), 4: ("a  b", 4)}


def test_every_token_is_packed(spark, tmp_path):
    rng = random.Random(8)
    docs = table(spark, [(1, prose(rng, 3000)), (2, ""), (3, None), (4, prose(rng, 10))])
    rows = STAGES["packing"](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4}
    for doc in (1, 2, 3, 4):
        own = sorted((r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == doc)
        assert sum(n for _, n, _ in own) == own[0][2] and [a for a, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))]
    assert all(r.doc_tokens == 1 for r in rows if r.doc_id in (2, 3))


def test_shared_model_reads_counted_tails(spark):
    from themelift.llm.toxicity import grams_of, shared_model

    gram, _ = grams_of([b"the", b"then", b"other"])
    shared = shared_model(spark.createDataFrame([(int(g),) for g in set(gram.tolist())], "gram long"))
    assert "gram#" not in shared._jdf.queryExecution().executedPlan().toString()  # no order is counted anew from the grams
    assert all(0 < r.p < 1 for r in shared.collect())
