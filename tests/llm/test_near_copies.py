"""Near copies at 0.8 and above by brute force: the forest of a group, and the stage of the pipeline."""

import random

import corpus_pipeline
import numpy as np
import pytest

from texmill.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sets(texts):
    words = [t.lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def alike(a, b):
    return bool(a | b) and 5 * len(a & b) >= 4 * len(a | b)


def linked(made):
    group = list(range(len(made)))
    for i in range(len(made)):
        for j in range(i):
            if group[i] != group[j] and alike(made[i], made[j]):
                group = [group[i] if g == group[j] else g for g in group]
    return group


def planted(n=40):
    """Texts of 60 to 300 words, each with two copies that differ in a few words: many at 0.8 to 0.9, some below."""
    rng = random.Random(4)
    texts = []
    for _ in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(words))
        for _ in range(2):
            copy = list(words)
            for at in rng.sample(range(len(copy)), max(1, len(copy) * rng.randrange(10, 28) // 1000)):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    return texts


def test_forest_joins_what_pairs_join():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    made = [base]
    for _ in range(120):  # a chain and its branches
        old = made[int(rng.integers(len(made)))]
        made.append(np.unique(np.r_[rng.choice(old, len(old) - (cut := int(rng.choice([8, 8, 30]))), replace=False), rng.integers(0, 1 << 62, cut + 1).astype(np.uint64)]))
    got = list(range(len(made)))
    for i, j in near_copies.forest(made):
        got = [got[i] if g == got[j] else g for g in got]
    want = linked([set(map(int, m)) for m in made])
    assert [got.index(g) for g in got] == [want.index(g) for g in want] and 1 < len(set(want)) < len(want)


@pytest.mark.parametrize("tile", [near_copies.TILE, 2000])
def test_stage_finds_planted_copies(spark, tile, monkeypatch):
    texts = planted()
    made = sets(texts)
    between = [(i, j) for i in range(len(made)) for j in range(i) if alike(made[i], made[j]) and 10 * len(made[i] & made[j]) < 9 * len(made[i] | made[j])]
    far = [(i, j) for i, j in between if bin(simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).count("1") > 4]
    assert len(between) >= 20 and len(far) >= 10  # what simhash within 4 bits does not link
    monkeypatch.setattr(near_copies.grouped, "__defaults__", (tile,))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    group = linked(made)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect())
    assert kept == sorted({g: i for i, g in reversed(list(enumerate(group)))}.values())


def test_null_ids_link_and_are_kept_apart(spark):
    """A chain of fingerprints through a row with null doc_id, a group of null ids, and null ids in the stage."""
    rows = [((1,), 0), ((None,), 15), ((2,), 255), ((None,), -1), ((None,), -2), ((7,), 0x5555555555555555)]
    df = spark.createDataFrame(rows, "_doc struct<doc_id: long>, fp long")
    got = {r.fp: r.component_id for r in simhash.grouped(df).collect()}
    assert got == {0: 1, 15: 1, 255: 1, -1: None, -2: None, 0x5555555555555555: 7}
    texts = [" ".join(f"{k}{i}" for i in range(80)) for k in "abc"]
    docs = [(None, texts[0], "en", "a", 9), (None, texts[1], "en", "a", 9), (None, texts[2], "en", "a", 9), (5, texts[2] + " end", "en", "a", 9)]
    kept = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(docs, SCHEMA), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, texts[0]), (0, texts[1]), (5, texts[2] + " end")]


def test_fingerprints_link_as_operator_6_does(spark):
    """SimHash over five-word shingles, by pigeonhole blocks: the links are those of all pairs within the distance, equal ones too."""
    texts = planted(30)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)] + [(len(texts), " ", "en", "a", 1)], SCHEMA)
    rows = near_copies.sketched(docs)
    found = {r.doc_id: r for r in rows.select("_doc.doc_id", "vertex", "fp").collect()}
    prints = [simhash.fingerprint(t, 5) for t in texts]
    assert [found[i].fp % (1 << 64) for i in range(len(texts))] == prints and found[len(texts)].fp == 0
    group, want = {found[i].vertex: found[i].vertex for i in range(len(texts))}, 0
    for r in near_copies.by_simhash(rows.filter("size(bands) > 0")).collect():
        group = {k: group[r.a] if g == group[r.b] else g for k, g in group.items()}
    for i in range(len(texts)):
        for j in range(i):
            near = (prints[i] ^ prints[j]).bit_count() <= simhash.DISTANCE
            want += near
            assert not near or group[found[i].vertex] == group[found[j].vertex]
    assert want >= 5 and len(set(group.values())) >= 30
