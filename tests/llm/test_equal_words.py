"""Words, lines and windows are told apart by more than a polynomial of their bytes: texts made of
a Thue-Morse word and its complement, which agree under every polynomial modulo 2**64."""

import hashlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from themelift.llm import bpe, common, doc_stats, packing, substring, toxicity
from themelift.llm.queries import vocabulary_path

ONE = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
OTHER = ONE.translate(str.maketrans("ab", "ba"))


def test_codes_and_hashes():
    data, offsets = common.text_buffer(pa.array([f"{ONE} {OTHER} {ONE}", None, "", f"{OTHER}{ONE}", ONE]))
    starts, ends, row = common.word_bounds(data, offsets)
    codes, words = common.word_codes(data, starts, ends)
    assert [words[c].decode() for c in codes] == [ONE, OTHER, ONE, OTHER + ONE, ONE]
    hashes = common.word_hashes(data, starts, ends)
    assert len({tuple(h) for h in hashes.tolist()}) == 3 and row.tolist() == [0, 0, 0, 3, 4]


def test_lines_and_windows_of_a_text():
    data, offsets = common.text_buffer(pa.array([f"{ONE}\n{OTHER}\n{ONE}", f"{ONE} x y\n{OTHER} x y", None]))
    found = doc_stats.counts(data, offsets)
    assert found["n_dup_lines"].tolist() == [1, 0, 0]
    assert found["n_repeat_words"].tolist() == [0, 0, 0]
    assert found["n_distinct_words"].tolist() == [2, 4, 0]


def test_ids_equal_the_library():
    text = f"{ONE} {OTHER} x {OTHER}"
    want = Tokenizer.from_file(vocabulary_path()).encode(text, add_special_tokens=False).ids
    data, offsets = common.text_buffer(pa.array([text]))
    own, _ = bpe.encoder(vocabulary_path())
    for _ in range(2):  # the second time the words are remembered
        assert own.encode(data, offsets)[0].tolist() == want
    assert np.frombuffer(packing.Ids(vocabulary_path()).of(data, offsets)[0], "<u4")[:-1].tolist() == want


def test_numbers_of_words_with_one_half_in_common(monkeypatch):
    whole = common.hashes_of

    def half(words):
        found = whole(words).copy()
        found[:, 0] = 7
        return found

    monkeypatch.setattr(common, "hashes_of", half)
    numbers = common.WordNumbers(100)
    data, offsets = common.text_buffer(pa.array(["a b c a", "b b"]))
    known: list[bytes] = []
    for _ in range(3):
        each, _, new, _ = numbers.number(data, offsets)
        known += new
        assert [known[k] for k in each] == [b"a", b"b", b"c", b"a", b"b", b"b"]


def test_passages(spark):
    words = [f"w{k}" for k in range(60)]
    one, other = " ".join([*words[:30], ONE, *words[30:]]), " ".join([*words[:30], OTHER, *words[30:]])
    docs = spark.createDataFrame([(1, one), (2, other), (3, other)], "doc_id long, text string")
    rows = {r.doc_id: r for r in substring.remove_passages(docs).collect()}
    assert [rows[k].n_removed for k in (1, 2, 3)] == [0, 0, 61]
    assert hashlib.sha256(rows[2].kept.encode()).hexdigest() == hashlib.sha256(other.encode()).hexdigest()


def test_toxic_word_beside_its_twin(spark):
    docs = spark.createDataFrame([(1, ONE, 0), (2, OTHER, 1)], "row long, text string, y int")
    rows = toxicity.words_of(docs).collect()
    assert len({r.word for r in rows}) == 2
    counter = toxicity.Counter()
    data, offsets = common.text_buffer(pa.array([ONE, OTHER]))
    list(counter.add(data, offsets, np.array([0, 1])))
    assert len(counter.texts) == 2
