"""The operators against brute force, on tables small enough for it."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from themelift.llm import boosted_trees, bpe, common, components, html_extract, packing, quality_rules, simhash, substring, topk, toxicity
from themelift.llm.queries import QUERIES, vocabulary_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def odd_texts():
    random.seed(1)
    points = [(0x20, 0x250), (0x250, 0xD800), (0xE000, 0x30000)]
    letters = [chr(random.randrange(*random.choice(points))) for _ in range(60_000)]
    return [
        "<|endoftext|> Hello", "a<|startoftext|>b", "\xa0x y", "İI ß ﬁ é", "日本語 テスト", "it's DON'T 123 ½", "",
        "\x00a", "<|ENDOFTEXT|>", "Σ ΑΣ ΑΣ.", "\x1c a\x85b", "a" * 5000, "é ́ x", "<|endof<|endoftext|>text|>",
        "'S 'LL", " ", "\n", "x,. y., -, é, —, a., J̌.",
        *("".join(letters[i : i + 20]) for i in range(0, len(letters), 20)),
    ]


def test_ids_equal_the_library(texts):
    rows = odd_texts() + list(texts.values())
    tokenizer = Tokenizer.from_file(vocabulary_path())
    want = [e.ids for e in tokenizer.encode_batch(rows, add_special_tokens=False)]
    own, _ = bpe.encoder(vocabulary_path())
    data, offsets = common.text_buffer(pa.array(rows))
    ids, at = own.encode(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want
    assert [bpe.decode(own.vocabulary, x) for x in want] == [tokenizer.decode(x, skip_special_tokens=False) for x in want]
    library = packing.Ids(vocabulary_path()).of(data, offsets)
    assert [np.frombuffer(x, "<u4")[:-1].tolist() for x in library] == want


def test_memory_of_words_starts_anew(monkeypatch, texts):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 50)
    own = bpe.Encoder(bpe.load_vocabulary(vocabulary_path()))
    tokenizer = Tokenizer.from_file(vocabulary_path())
    for text in list(texts.values())[:20]:
        data, offsets = common.text_buffer(pa.array([text]))
        assert own.encode(data, offsets)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_digests(spark, texts):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    for r in QUERIES["op10_bpe_round_trip"](spark, SF).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_and_decode_tables(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    encoded = bpe.encode_texts(docs, vocabulary_path())
    digests = {r.doc_id: r for r in QUERIES["op10_bpe_round_trip"](spark, SF).collect()}
    for r in bpe.decode_ids(encoded, vocabulary_path()).collect():
        assert digests[r.doc_id].n_tokens == len(r.ids)
        assert digests[r.doc_id].decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


@pytest.mark.parametrize("lengths", [[], [1], [2048], [2047], [5000, 1, 1, 1], list(range(1, 400, 7)), [300] * 50, [4096, 2049]])
def test_pack(lengths):
    at = [0] * len(lengths)
    sequences = packing.pack(lengths)
    for row in sequences:
        total = sum(p[0] for p in row)
        assert 0 < total <= 2048 and total & (total - 1) == 0
    for doc, start, n in sorted((d, s, n) for row in sequences for n, d, s in row):
        assert at[doc] == start and n > 0
        at[doc] += n
    assert at == lengths


def test_packing_query(spark, texts):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    sequences, documents = {}, {}
    for r in QUERIES["op8_packing"](spark, SF).collect():
        sequences.setdefault(r.sequence_id, []).append(r)
        documents.setdefault(r.doc_id, []).append(r)
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in rows]).tolist()
        assert [r.offset for r in rows] == [0, *ends[:-1]] and ends[-1] == rows[0].sequence_tokens
        assert ends[-1] <= 2048 and ends[-1] & (ends[-1] - 1) == 0
    assert documents.keys() == texts.keys()
    for doc, rows in documents.items():
        ids = [*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_steps_are_balanced():
    sizes = [2048] * 200 + [512] * 100 + [16] * 9
    loads = Counter()
    for size, step in zip(sizes, packing.step_groups(sizes, 1 << 16), strict=True):
        loads[step] += size
    assert max(loads.values()) - min(loads.values()) <= 2048


def fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_copies_against_all_pairs(spark, texts):
    prints = {i: fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = roots(ids, near)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in QUERIES["op4_simhash_near_dedup"](spark, SF).collect()}
    assert got == {i: (prints[i], want[i]) for i in ids}


@pytest.mark.parametrize("radius, count, nodes", [(4, 100, 4096), (4, 10**9, 16), (2, 100, 16), (4, 10**15, 4096)])
def test_links_of_dense_groups(spark, radius, count, nodes):
    random.seed(radius + nodes)
    values = set()
    for _ in range(12):
        center = random.getrandbits(64)
        for _ in range(40):
            values.add(center ^ sum(1 << b for b in random.sample(range(64), random.randint(0, radius + 2))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = [(r.a, r.b) for r in simhash.links(table, radius, count, nodes).collect()]
    full = [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius]
    assert {tuple(sorted(x)) for x in links} <= {tuple(sorted(x)) for x in full}
    assert roots(signed, links) == roots(signed, full)


def test_components_of_a_chain(spark):
    random.seed(3)
    nodes = list(range(300))
    random.shuffle(nodes)
    links = list(zip(nodes, nodes[1:], strict=False))[:250] + [(5, 5), (7, None)] + [(9, 11)] * 3
    table = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components.components(table).collect()}
    plain = [x for x in links if None not in x and x[0] != x[1]]
    want = roots({n for x in plain for n in x}, plain)
    assert got == want


def kept_words(docs, window):
    first = {}
    for i in sorted(docs):
        for p in range(len(docs[i]) - window + 1):
            first.setdefault(tuple(docs[i][p : p + window]), i)
    out = {}
    for i, words in docs.items():
        gone = set()
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] < i:
                gone.update(range(p, p + window))
        out[i] = [w for k, w in enumerate(words) if k not in gone]
    return out


@pytest.mark.parametrize("window, held", [(50, 1 << 21), (31, 64), (64, 64)])
def test_passages_against_brute_force(spark, monkeypatch, window, held):
    monkeypatch.setattr(substring, "HELD_ROWS", held)
    random.seed(window)
    words = [f"w{i}" for i in range(3000)]
    shared = [random.choices(words, k=random.choice([window - 1, window, window + 1, 3 * window])) for _ in range(12)]
    docs = {}
    for i in range(1, 80):
        docs[i] = [
            w
            for _ in range(random.randint(1, 4))
            for w in random.choices(words, k=random.randint(0, 90)) + random.choice([*shared, [], ["same"] * 120])
        ]
    docs[90] = docs[10]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    want = kept_words(docs, window)
    for r in substring.remove_passages(table.repartition(5), window).collect():
        assert r.kept == " ".join(want[r.doc_id])
        assert (r.n_words, r.n_removed) == (len(docs[r.doc_id]), len(docs[r.doc_id]) - len(want[r.doc_id]))


def test_cover_has_every_difference():
    differences = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert differences == set(range(substring.PERIOD))


def test_rule_ledger_and_ablations(spark):
    rows = quality_rules.ledger(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    broken = [r.failures for r in rows.collect()]
    for policy in quality_rules.POLICIES:
        every = quality_rules.mask(quality_rules.POLICIES[policy])
        for r in quality_rules.ablations(rows, policy).collect():
            bit = quality_rules.mask((r.rule,))
            assert r.n_failed == sum(f & bit > 0 for f in broken)
            assert r.n_failed_alone == sum(f & every == bit for f in broken)
            assert r.n_kept == sum(f & every == 0 for f in broken)
            assert r.n_kept_without == sum(f & every & ~bit == 0 for f in broken)


def test_flat_trees_equal_nested_walks():
    random.seed(4)
    x = np.random.default_rng(4).normal(size=(400, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    trees = boosted_trees.grow(x, y, trees=30)
    margins = trees.margins(x)
    for row, margin in zip(x[:50], margins, strict=False):
        total = trees.start
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        assert abs(total - margin) < 1e-9
    assert ((margins > 0) == (y > 0)).mean() > 0.97


@pytest.mark.parametrize("name, label, least", [("op3_quality_classifier", "quality", 0.97), ("op7_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label), "doc_id")
    got = rows.where("held_out").agg(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert got.n > 500 and got.a >= least


def test_slots_are_sparks(spark):
    keys = [0, 5, -7, 123456789012345, 1 << 47]
    want = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(F.pmod(F.xxhash64("k"), F.lit(1 << 23))).collect()]
    assert toxicity.slot_of(np.array(keys), 1 << 23).tolist() == want


def test_shared_model_sums_to_one(spark):
    words = [b"abab", b"abba", b"cab", b"a", b"bbbbbb"]
    gram, word = toxicity.grams_of(words)
    table = spark.createDataFrame([(int(g), 1, 0, 0) for g in set(gram.tolist())], "gram long, c0 long, c1 long, c2 long")
    shared = {r.tail: r.p for r in toxicity.shared_model(table).collect()}
    assert all(0 < p <= 1 for p in shared.values())
    sums = Counter()
    for tail, p in shared.items():
        sums[tail >> 8] += p
    assert all(s <= 1 + 1e-9 for s in sums.values())


def test_top_k_tiles(spark):
    rng = np.random.default_rng(7)
    rows = rng.integers(-3, 4, size=(900, 6)).astype(float) / 16
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")
    v = topk.integer_vectors(table).cache()
    got = {}
    for r in topk.top_k(v, v.where("id % 50 = 0"), k=5, tile_queries=7, tile_vectors=60).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    whole = np.floor(256 * rows).astype(int)
    for q in range(0, 900, 50):
        scores = whole @ whole[q]
        best = [i for i in np.lexsort((np.arange(900), -scores)) if i != q][:5]
        assert [got[q][k + 1] for k in range(5)] == [(i, scores[i]) for i in best]


def test_products_of_large_numbers():
    a = np.array([[2.0**40, 3.0], [1.0, -(2.0**45)]])
    assert topk.products(a, a).tolist() == [[2**80 + 9, 2**40 - 3 * 2**45], [2**40 - 3 * 2**45, 1 + 2**90]]


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-menu">
<header class="site-header"><h1>Site</h1></header><div id="cookie-notice">We use cookies.</div>
<nav><ul><li><a href=x>Home</a><li>Two</ul></nav><main><div class="post-content"><h2>Ti&amp;tle</h2>
<p>First para, <i>with</i> x &lt;b&gt; markup.&nbsp;Yes<p>Second <b>para.<div class=ad>Buy now</div><ul><li>one<li>two</ul>
<form><p>Sign up</p></form><script>var a="<p>no</p>"</script><!-- <p>no</p> --></div></main>
<section id="comments"><div class="comment"><p>A long comment, with a lot of text, and commas, and more.</p></div></section>
<aside>Side</aside><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(
    "page, text",
    [
        (PAGE, "Ti&tle\nFirst para, with x <b> markup. Yes\nSecond para.\none\ntwo"),
        ("", ""),
        ("plain text", "plain text"),
        ("<div>Long enough text, with marks. And more, text.</div><div class=footer>foot</div>", "Long enough text, with marks. And more, text."),
        ("<article><h1>A</h1><p>b<br>c</p><article class=comment><p>no</p></article></article><p>outside</p>", "A\nb c"),
        ("<body><nav>only a menu</nav></body>", ""),
        ("<article><p>a < b &amp c &#x41;<p>x</p></p>y", "a < b & c A\nx\ny"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_main_text_of_very_deep_pages():
    assert html_extract.main_text("<div>x" * 20_000).count("x") > 0
    assert html_extract.main_text('<a "' * 50_000) is not None


def test_packed_columns_round_trip():
    part, a, b = np.array([2, 0, 2, 1]), np.array([5, 6, 7, 8]), np.array([1, 2, 3, 4], np.int32)
    got = {k: common.unpacked([blob], [np.int64, np.int32]) for k, blob in common.packed(part, 3, [a, b])}
    assert {k: [x.tolist() for x in v] for k, v in got.items()} == {0: [[6], [2]], 1: [[8], [4]], 2: [[5, 7], [1, 3]]}


def test_a_worker_holds_one_thing_at_a_time():
    first = common.hold("a", list)
    assert common.hold("a", list) is first
    common.hold("b", dict)
    assert common.hold("a", list) is not first
    assert list(common.tidy(lambda batches: (x + 1 for x in batches), "b")(iter([1, 2]))) == [2, 3]
    assert "a" not in common._held
