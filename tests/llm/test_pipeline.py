"""The stages, each against a plain version of its decision."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from texmill.llm import quality_rules, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stage(spark, docs[-1], SF).cache())
    return docs


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def shingles(text):
    """The five-word shingles, A-Z lower-cased; one of a shorter text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.schema.simpleString() == stages[0].schema.simpleString()


def test_decisions_take_effect(spark, stages):
    docs, ruled, scored, unique, clean, packed = stages
    assert ids(ruled) == {r._doc.doc_id for r in quality_rules.judged(docs).filter("kept").collect()}
    assert ids(scored) <= ids(ruled)
    rows = sorted(scored.select("doc_id", "text").collect())
    made = [shingles(r.text or "") for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and (made[i] == made[j] or 5 * len(made[i] & made[j]) >= 4 * len(made[i] | made[j])):
                group = [group[j] if g == group[i] else g for g in group]
    assert ids(unique) == {rows[group.index(g)].doc_id for g in set(group)} and unique.count() == len(ids(unique))
    assert ids(clean) == ids(unique)
    assert not [r for r in clean.collect() if re.search("[0-9a-f]{32}", r.text) or r.n_chars != len(r.text)]
    assert ids(packed) == ids(clean)


def test_good_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    long = stages[0].filter(F.size(F.split("text", r"\s+")) >= 25).select("doc_id")
    good = ids(labels.join(long, "doc_id"))
    assert good <= ids(stages[2])


def test_repeated_rows_and_extra_columns(spark):
    text = " ".join(f"word{i % 37} of line{i}" for i in range(60))
    rows = [(1, text, "en", "a", 5, "k"), (1, text, "en", "a", 5, "k"), (2, text + " end", "en", "a", 5, "k"), (3, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")
    once = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    assert sorted(r.doc_id for r in once.collect()) == [1, 3] and once.columns == docs.columns


def test_user_columns_survive_every_stage(spark):
    """Columns that have the names of the stages' own keep their values."""
    own = {"_row": 777, "_doc": 5, "vertex": 6, "kept": 7, "d2": 8, "score": 9, "_spans": 10, "group": 11, "a.b": 12}
    good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id")
    texts = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars > 1500").join(good, "doc_id").orderBy("doc_id").limit(3).collect()
    rows = [(r.doc_id, r.text, "en", "a", 9, *own.values()) for r in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in own))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all([r[c] for c in own] == list(own.values()) for r in got), name


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_queries_are_registered():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")} == set(range(1, 11)) and "pipeline" in registry.QUERIES
