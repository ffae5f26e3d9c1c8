"""The whole of op3 against a plain hidden Markov model that goes token by token."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from texmill.llm import hmm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER)) + [""]


def corpus(n=60):
    rng, out = np.random.default_rng(1), []
    for i in range(n):
        kind = "ab" if i % 2 else "xy"
        words = [f"{kind[int(rng.integers(2))]}{min(40, int(rng.geometric(0.1)))}{'.' * int(rng.integers(2))}" for _ in range(rng.integers(0, 60))]
        out.append((i, " ".join(words).capitalize()))
    return [*out, (None, "x1 x2 never"), (100, None), (101, " \t "), (102, out[3][1])]


def plain(rows, how):
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    texts = [split(t or "") for _, t in rows]
    counts = Counter(w for ws, h in zip(texts, held, strict=True) if not h for w in ws)
    ranked = [""] + sorted((w for w in counts if w), key=lambda w: (-counts[w], w))
    own = {w: k for k, w in enumerate(ranked[: how.symbols])}
    code = lambda w: own[w] if w in own else hmm.klass(w, how)
    in_class, types = Counter(), Counter()
    for w, c in counts.items():
        if w not in own:
            in_class[code(w)] += c
            types[code(w)] += 1
    n = sum(counts.values())
    coded = [[code(w) for w in ws] for ws in texts]

    a = min(how.anchors, how.symbols - 1)
    sums = np.zeros((how.kinds + 1, a))
    share = np.array([counts[ranked[k]] / max(1, n) if k < len(ranked) else 0 for k in range(1, a + 1)])
    for ks, h in zip(coded, held, strict=True):
        if not h:
            over = [(ks.count(k + 1) - len(ks) * share[k]) / math.sqrt(len(ks) * share[k] + 1) for k in range(a)]
            best = int(np.argmax(over))
            sums[-1, best] += 1
            for k in ks:
                sums[k, best] += 1
    m = hmm.beginning(sums, how)

    def alphas(ks):
        out, now = [], m.start
        for t, k in enumerate(ks):
            now = (now @ m.move if t else now) * m.emit[k]
            out.append((now / now.sum(), now.sum()))
            now = now / now.sum()
        return out

    for _ in range(how.passes):
        starts, moves, emitted = np.zeros(how.states), np.zeros((how.states,) * 2), np.zeros((how.kinds, how.states))
        for ks, h in zip(coded, held, strict=True):
            if h:
                continue
            run, beta = alphas(ks), np.ones(how.states)
            for t in range(len(ks) - 1, -1, -1):
                gamma = run[t][0] * beta
                emitted[ks[t]] += gamma
                if t == 0:
                    starts += gamma
                else:
                    ahead = m.emit[ks[t]] * beta / run[t][1]
                    moves += m.move * np.outer(run[t - 1][0], ahead)
                    beta = m.move @ ahead
        m = hmm.estimate(starts, moves, emitted)

    for (i, _), h, ws, ks in zip(rows, held, texts, coded, strict=True):
        score = sum(math.log10(x) for _, x in alphas(ks))
        for w, k in zip(ws, ks, strict=True):
            if w not in own and in_class[k]:
                score += math.log10((counts[w] - how.discount if counts[w] else how.discount * types[k]) / in_class[k])
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in ws)
        yield i, h, len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 6), round(score, 6)


@pytest.mark.parametrize("how", [hmm.Setup(states=3, symbols=12, classes=7, table=20, anchors=5), hmm.Setup(states=4, symbols=40, classes=16, table=64, anchors=9)])
def test_scores_equal_a_plain_model(spark, how):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in hmm.scored(docs, how).collect())
    assert got == Counter(plain(rows, how))


def test_tokens_split_at_six_characters_only():
    texts = ["", " ", " A\x0bB\x0c\tc\r\nÉÀ\x1c\x85  z ", "x", "\x00\x1f "]
    words, sizes = hmm.tokens(pa.array(texts))
    assert words.to_pylist() == [w for t in texts for w in split(t)[:-1]] and sizes.tolist() == [len(split(t)) - 1 for t in texts]
    words, sizes = hmm.tokens(pa.array(["zz", *texts, "yy"])[1:-1])  # a slice
    assert words.to_pylist() == [w for t in texts for w in split(t)[:-1]] and sizes.tolist() == [len(split(t)) - 1 for t in texts]


def test_class_as_expression(spark):
    how = hmm.Setup()
    words = ["", "a", "abc.", "É'", "...", "x)!", "日本語四", "🙂🙂🙂🙂;", "don't"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", hmm.klass_of(F.col("w"), how).alias("k")).collect()
    assert [(r.w, r.k) for r in got] == [(w, hmm.klass(w, how)) for w in words]


def test_states_begin_apart():
    rng = np.random.default_rng(0)
    texts = [np.r_[rng.integers(1, 5, 30) + 4 * (i % 2), 0] for i in range(40)]
    model = hmm.beginning(hmm.anchored(texts, np.full(8, 30 / 31 / 8), 10), hmm.Setup(states=2, symbols=10, classes=0))
    low, high = model.emit[1:5].sum(axis=0), model.emit[5:9].sum(axis=0)
    assert sorted((low > high).tolist()) == [False, True] and max(low) > 0.8 and max(high) > 0.8


def test_long_texts_are_scored_whole():
    rng = np.random.default_rng(2)
    p = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s) + 0.1)
    m = hmm.Model(p(3), p(3, 3), p(3, 6).T)
    texts = [rng.integers(0, 6, n) for n in (5000, 1, 17, 8, 16, 8)]
    flat, first, there, order = hmm.layout(texts)
    rank = np.arange(len(flat)) - np.repeat(first[:-1], there)
    want = np.empty(len(texts))
    want[order] = np.bincount(rank, np.log10(hmm.forward(m, m.emit[flat], first, there)[1]))
    assert np.allclose(hmm.likelihoods(m, texts), want, rtol=1e-12)
