"""Operators 2, 5, 9 and 10 against plain versions on inputs that are made to be hard."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from texmill.llm import bpe, license_scan, packing, quality_classifier
from texmill.llm.text import id_remainder


def points():
    """Every code point of the blocks in common use, and every 61st of the others."""
    return [c for c in [*range(0x3400), *range(0x3400, 0x110000, 61)] if not 0xD800 <= c < 0xE000]


# 2


def test_packing_ids_of_every_code_point():
    code = packing.encoder(None)
    for c in points():
        text = f"A{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}"
        assert code.ids(text).tolist() == code.exact.encode(text, add_special_tokens=False).ids, hex(c)


# 5


def brute(text, templates, share):
    """Templates with that share of their shingles within some run of windows, by comparing words at every place."""
    words, found = [license_scan.bare(w) for w in license_scan.WORD.findall(text)], set()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    for name, t in templates.items():
        own = [license_scan.bare(w) for w in license_scan.WORD.findall(t)]
        want = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        size = 1 << (len(want) - 1).bit_length()
        for at in range(0, len(grams), size if size > 1 else 1):
            if len(want & set(grams[max(0, at - size) : at + 3 * size])) >= share * len(want):
                found.add(name)
    return found


def test_scan_equals_brute_force():
    rng = np.random.default_rng(16)
    vocabulary = [f"w{i}" for i in range(900)]
    templates = {f"t{k}": " ".join(rng.choice(vocabulary, n)) for k, n in enumerate((5, 6, 7, 9, 14, 25, 60, 130))}
    texts = ["", "one two"]
    for _ in range(250):
        words = templates[f"t{rng.integers(len(templates))}"].split()
        for at in rng.choice(len(words), int(len(words) * rng.choice([0, 0, 0.02, 0.04, 0.1]) + 0.5), replace=False):
            words[at] = "changed"
        body = list(rng.choice(vocabulary, rng.integers(0, 300)))
        at = int(rng.integers(0, len(body) + 1))
        texts.append(" ".join([*body[:at], *words, *body[at:]]))
    found = license_scan.scan(texts, license_scan.prepared(templates, 0.8, 1e-4), 0.8, {})
    want = [brute(t, templates, 0.8) for t in texts]
    assert [{m[0] for m in ms} for ms in found] == want and 100 < sum(map(len, want)) < 245


def test_words_decide_not_hashes(monkeypatch):
    known = license_scan.prepared({"t": "aspjwwk two three four five"}, 0.8, 1e-4)
    assert license_scan.scan(["x rnrsgud two three four five y"], known, 0.8, {}) == [[]]
    monkeypatch.setattr(license_scan, "word_hash", lambda w: 7)  # every shingle meets every other
    known = license_scan.prepared({"t": "aspjwwk two three four five"}, 0.8, 1e-4)
    got = license_scan.scan(["x rnrsgud two three four five y", "z Aspjwwk, two three four five y"], known, 0.8, {})
    assert [[m[0] for m in ms] for ms in got] == [[], ["t"]]


# 9


def test_forest_walks_like_a_plain_tree():
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(900, 5)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    forest = quality_classifier.fit(x, y, quality_classifier.Boosting(trees=30, depth=3))

    def walk(row):
        odds = forest.start
        for feature, edge, leaf in zip(forest.feature, forest.edge, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > edge[node] else 1)
            odds += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-odds))

    assert np.allclose(forest.score(x), [walk(row) for row in x], rtol=1e-12)


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(12)
    x = rng.integers(0, 9, size=(400, 4)).astype(float)
    y = ((x[:, 2] > 5) | (rng.random(400) < 0.2)).astype(float)
    how = quality_classifier.Boosting(trees=1, depth=1, min_rows=5)
    forest, g, h = quality_classifier.fit(x, y, how), y.mean() - y, y.mean() * (1 - y.mean())
    worth = lambda rows: g[rows].sum() ** 2 / (h * rows.sum() + how.l2)
    gains = {(j, e): worth(x[:, j] <= e) + worth(x[:, j] > e) for j in range(4) for e in range(8) if min((x[:, j] <= e).sum(), (x[:, j] > e).sum()) >= 5}
    best = max(gains, key=gains.get)
    assert (int(forest.feature[0, 0]), forest.edge[0, 0]) == best
    left = x[:, best[0]] <= best[1]
    assert np.allclose(forest.leaf[0], [-how.rate * g[r].sum() / (h * r.sum() + how.l2) for r in (left, ~left)])


def test_repeated_ids_do_not_push_out_a_class(spark):
    """Ten ids of thirty copies each: a bound of ten ids keeps all ten."""
    rows = [(i, f"{'good words here. ' * 9 if i % 2 else 'BAD $$$ ### '} {i}") for i in range(10) for _ in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    how = quality_classifier.Boosting(min_rows=1, most_rows=10)
    forest = quality_classifier.trained(docs, labels, F.lit(True), how)
    got = {r.i: r.score for r in quality_classifier.scored(docs, forest).select(F.col("_doc.doc_id").alias("i"), "score").collect()}
    assert all((got[i] > 0.9) == bool(i % 2) and (got[i] < 0.1) == (i % 2 == 0) for i in got)


def test_odd_column_names_stay(spark):
    docs = spark.createDataFrame([(1, "some text", 5, "x", 7)], "doc_id long, text string, `a.b` int, `c``d` string, `_text` int")
    forest = quality_classifier.trained(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), id_remainder(F.col("doc_id"), 5) != 9)
    (row,) = quality_classifier.scored(docs, forest, with_text=True).collect()
    assert row._doc.asDict() == {"doc_id": 1, "text": "some text", "a.b": 5, "c`d": "x", "_text": 7}


# 10


@pytest.fixture(scope="module")
def library():
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tk.no_truncation()
    tk.no_padding()
    return tk


def test_bpe_of_every_code_point(library):
    code = bpe.coder(None)
    texts = [f"A{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}" for c in points()]
    for text, (ids, n, decoded) in zip(texts, code.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert (ids, n, decoded) == (" ".join(map(str, want)), len(want), library.decode(want, skip_special_tokens=False)), ascii(text)


def test_bpe_of_random_texts(library):
    rng, code = np.random.default_rng(13), bpe.coder(None)
    letters = list("abcdetionshr'’ ,.-0123éßİıſΣςǅ…–“”•€→─\n\t ​ ́") + ["<|endoftext|>", "don't", "'LL", "ﬁ", "日本", "🙂"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)] + ["x" * 5000, "ab" * 3000, ""]
    for text, (ids, _, decoded) in zip(texts, code.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert hashlib.sha256(ids.encode()).digest() == hashlib.sha256(" ".join(map(str, want)).encode()).digest(), ascii(text)
        assert decoded == library.decode(want, skip_special_tokens=False)
