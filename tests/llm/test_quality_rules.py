"""The robust estimate against numpy: random-start minimum covariance determinants, and the whole verdict done plainly."""

import math
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from texmill.llm import quality_rules as q


def edge(values, p):
    """The quantile as the operator takes it."""
    return np.sort(values)[max(0, math.ceil(p * len(values)) - 1)]


def steps(x, m, c, rules, ridge, most):
    last = None
    for _ in range(most):
        d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        core = x[d2 <= edge(d2, rules.core)]
        m, c = core.mean(axis=0), np.cov(core.T, bias=True) + np.diag(ridge**2)
        det = np.linalg.slogdet(c)[1]
        if last is not None and abs(det - last) < 1e-10:
            break
        last = det
    return m, c, det


def ridges(groups, rules):
    off = {k: [1.4826 * edge(abs(v - edge(v, 0.5)), 0.5) for v in x.T] for k, x in groups.items()}
    n = {k: len(x) for k, x in groups.items()}
    return rules.ridge * (1e-4 + sum(np.array(off[k]) * n[k] for k in groups) / sum(n.values()))


def reweighted(x, m, c, rules, ridge):
    d = x.shape[1]
    d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    cut = q.chi2_quantile(rules.near, d)
    near = x[d2 <= cut * rules.core / q.chi2_cdf(q.chi2_quantile(rules.core, d), d + 2)]
    return near.mean(axis=0), np.cov(near.T, bias=True) * rules.near / q.chi2_cdf(cut, d + 2) + np.diag(ridge**2)


def native(spark, groups, rules):
    d = next(iter(groups.values())).shape[1]
    names = [f"v{i}" for i in range(d)]
    rows = [(k, *map(float, r)) for k, x in groups.items() for r in x]
    got = q.estimated(spark.createDataFrame(rows, "`group` string, " + ", ".join(f"{v} double" for v in names)), names, rules).collect()
    out = {}
    for r in got:
        w = np.zeros((d, d))
        w[np.tril_indices(d)] = r["whitening"]
        c = np.linalg.inv(w.T @ w)
        assert r["log_det"] == pytest.approx(np.linalg.slogdet(c)[1])
        out[r["group"]] = np.array(r["centre"]), c
    return out


def clouds():
    rng = np.random.default_rng(1)
    shape = np.array([[1, 0, 0, 0], [0.9, 0.3, 0, 0], [0.2, -0.4, 0.5, 0], [0, 0, 0.1, 2]])
    a = rng.normal(size=(400, 4)) @ shape.T + 3
    a[:120] = rng.normal(size=(120, 4)) * 0.2 + [9, -9, 4, 0]  # three in ten are outliers, close together
    b = rng.standard_t(4, size=(250, 4)) @ shape
    return {"a": a, "b": b, "c": rng.normal(size=(80, 4)) * [5, 0.1, 1, 1]}


def test_determinant_is_as_small_as_random_starts_find(spark):
    groups, rules = clouds(), q.Rules(settled=1e-3)
    ridge, rng = ridges(groups, rules), np.random.default_rng(2)
    got = native(spark, groups, rules)
    for k, x in groups.items():
        best = None
        for _ in range(300):
            some = x[rng.choice(len(x), 6, replace=False)]
            fit = steps(x, some.mean(axis=0), np.cov(some.T, bias=True) + np.diag(ridge**2), rules, ridge, 60)
            best = fit if best is None or fit[2] < best[2] else best
        m, c = reweighted(x, *best[:2], rules, ridge)
        off = got[k][0] - m
        assert off @ np.linalg.inv(c) @ off < 0.1 and abs(np.linalg.slogdet(got[k][1])[1] - np.linalg.slogdet(c)[1]) < 0.3
    assert np.abs(got["a"][0] - 3).max() < 0.5  # the outliers do not move it


def plain(t, symbols=q.SYMBOLS):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return len(w), sum(map(len, w)), len(set(w)), sum(len(x) <= 3 for x in w), sum("A" <= c <= "Z" for c in t), sum(c in string.punctuation for c in t)


def documents():
    rng, rows = np.random.default_rng(7), []
    words = ["".join(rng.choice(list("abcdeéfghij"), rng.integers(1, 10))) for _ in range(500)]
    for i in range(420):
        n = int(rng.integers(20, 260))
        text = " ".join(w + ("." if rng.random() < 0.07 else "," if rng.random() < 0.05 else "") for w in rng.choice(words, n)).capitalize()
        if i % 29 == 0:
            text = text.upper()
        elif i % 31 == 0:
            text = " ".join(w + "###" for w in text.split())
        elif i % 37 == 0:
            text = " ".join(rng.choice(words[:9], n))
        rows.append((i, text, ("en", None, "de")[i % 3], f"s{i % 2}"))
    return rows + [(1000 + i, rows[1][1], "en", "s1") for i in range(300)] + [(2000, None, "en", "s1"), (2001, "too few", "xx", "s9"), (2002, rows[2][1], "xx", None)]


def test_verdict_equals_a_plain_version(spark):
    rows, rules = documents(), q.Rules(min_group=50, settled=1e-6)
    got = {r._doc.doc_id: r for r in q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), rules).collect()}
    passing = [(i, plain(t or ""), lang, source) for i, t, lang, source in rows if not got[i].base_failed]
    sets = {}
    for _, c, lang, source in passing:
        sets.setdefault((lang, source), set()).add(c)
    small = {k for k, s in sets.items() if len(s) < rules.min_group}
    assert small and len(small) < len(sets)
    groups = {k: np.array(sorted(s), float) for k, s in sets.items() if k not in small}  # the pools of the small stay too small here
    assert sum(len(sets[k]) for k in small) < rules.min_group

    def vectors(c, r):
        n, chars, distinct, short, upper, marks = c.T
        return np.stack([np.log((chars + 20 * r[0]) / (n + 20)), np.sqrt((upper + 100 * r[1]) / (chars + 100)), np.sqrt((marks + 100 * r[2]) / (chars + 100)), np.sqrt((short + 100 * r[3]) / (n + 100)), np.log(distinct), np.log(n)], axis=1)

    typical = {k: [edge(c[:, a] / c[:, b], 0.5) for a, b in ((1, 0), (4, 1), (5, 1), (3, 0))] for k, c in groups.items()}
    x = {k: vectors(c, typical[k]) for k, c in groups.items()}
    ridge, judged = ridges(x, rules), 0
    for k, v in x.items():
        middle = np.array([edge(c, 0.5) for c in v.T])
        mad = np.array([1.4826 * edge(abs(c - m), 0.5) for c, m in zip(v.T, middle, strict=True)])
        z = (v - middle) / (mad + ridge)
        signs, clipped = z / np.sqrt((z**2).sum(axis=1) + 1e-12)[:, None] * (mad + ridge), np.clip(z, -1.5, 1.5) * (mad + ridge)
        starts = [np.diag(mad**2), np.cov(signs.T, bias=True), np.cov(clipped.T, bias=True)]
        trials = [steps(v, middle, c + np.diag(ridge**2), rules, ridge, rules.trial_steps) for c in starts]
        best = min(trials, key=lambda t: t[2])
        m, c = reweighted(v, *steps(v, *best[:2], rules, ridge, rules.most_steps)[:2], rules, ridge)
        for i, counts, lang, source in passing:
            if (lang, source) == k:
                y = vectors(np.array([counts], float), typical[k])[0] - m
                d2 = y @ np.linalg.inv(c) @ y
                assert got[i].d2 == pytest.approx(d2, rel=1e-3, abs=1e-3) and got[i].kept == (d2 <= rules.cut)
                judged += 1
    assert judged > 600 and {i for i, r in got.items() if not r.base_failed and not r.kept} >= {i for i in range(420) if i % 29 == 0 or i % 31 == 0}
    assert got[2000].d2 is None or not got[2000].kept
    assert got[2002].kept and got[2002].d2 is None  # nothing in a pool that is too small is rejected
    assert len({got[i].d2 for i in (1, *range(1000, 1300)) if got[i]._doc.source == "s1" and got[i]._doc.lang == "en"}) >= 1


def test_covariance_tells_repetition(spark):
    """A text of few distinct words is ordinary in every single statistic, not in its number of words and of distinct words."""
    rng = np.random.default_rng(9)
    n = np.exp(rng.normal(5, 0.8, 600))
    x = np.stack([np.log(n), 0.9 * np.log(n) + rng.normal(0, 0.02, 600)], axis=1)
    m, c = native(spark, {"g": x}, q.Rules())["g"]
    odd = np.array([5.0, 0.9 * 5.0 - 0.6]) - m
    assert (np.abs(odd) < 3 * np.sqrt(np.diag(c))).all() and odd @ np.linalg.inv(c) @ odd > 100


def test_user_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 5, "x", 7)], "doc_id long, text string, lang string, source string, kept int, `group` string, d2 int")
    (row,) = q.judged(docs, with_text=True).collect()
    assert row._doc.asDict() == {"doc_id": 1, "text": "a b", "lang": "en", "source": "s", "kept": 5, "group": "x", "d2": 7} and row.kept is False
    assert q.judged(docs.filter("false")).select(F.col("_doc.doc_id")).count() == 0
