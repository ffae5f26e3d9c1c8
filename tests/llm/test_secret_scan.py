"""Spans and redaction against plain versions, and texts with very many spans."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from texmill.llm import secret_scan

SPANS = "array<struct<start:int,kind:int,end:int,live:boolean>>"


def plain(text, spans):
    out, at = [], 0
    for s in spans:
        if s[0] >= at:
            out += [text[at : s[0]], "[SECRET]" if s[3] else "[EXAMPLE]"]
        at = max(at, s[2])
    return "".join(out) + text[at:]


@pytest.mark.parametrize("chunk", [7, secret_scan.CHUNK])
def test_redacted(spark, chunk, monkeypatch):
    monkeypatch.setattr(secret_scan, "CHUNK", chunk)
    rng, rows = random.Random(3), []
    for i in range(200):
        text = "".join(rng.choice("ab\n é🙂") for _ in range(rng.randrange(60)))
        spans = sorted((a, rng.randrange(4), rng.randrange(a + 1, len(text) + 1), rng.random() < 0.5) for a in (rng.randrange(len(text)) for _ in range(rng.randrange(9) if text else 0)))
        rows.append((i, text, spans))
    rows.append((200, "z" * 14, [(0, 0, 14, True)]))
    df = spark.createDataFrame(rows, f"i int, t string, s {SPANS}").select("i", secret_scan.redacted(F.col("t"), F.col("s")).alias("r"))
    assert {r.i: r.r for r in df.collect()} == {i: plain(t, s) for i, t, s in rows}


def test_running(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(100) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 4, 5, 8, 9, 31, 64, 65])]
    df = spark.createDataFrame(rows, "i int, x array<int>")
    got = df.select("i", secret_scan.running(F.col("x"), lambda a, b: a + b).alias("s"), secret_scan.running(F.col("x"), lambda a, b: F.greatest(a, b)).alias("m"))
    for r in got.collect():
        x = rows[r.i][1]
        assert r.s == [sum(x[: k + 1]) for k in range(len(x))] and r.m == [max(x[: k + 1]) for k in range(len(x))]


def test_blobs_beside_and_upon_other_spans(spark):
    rng, rows = random.Random(5), []
    for i in range(150):
        starts = sorted(rng.randrange(60) for _ in range(rng.randrange(10)))
        rows.append((i, sorted((a, k := rng.randrange(4), a + rng.randrange(1, 12), True) for a in starts)))
    touches = lambda b, x: x[1] != 3 and x[0] < b[2] and x[2] > b[0]
    want = {i: [s for s in ss if s[1] != 3 or not any(touches(s, x) for x in ss)] for i, ss in rows}
    got = spark.createDataFrame(rows, f"i int, s {SPANS}").select("i", secret_scan._apart(F.col("s"), 3).alias("s")).collect()
    assert {r.i: [tuple(s) for s in r.s] for r in got} == want


def test_a_text_of_very_many_spans(spark):
    text = " ".join(f"{k:032x} é" for k in range(100_000))
    docs = spark.createDataFrame([(1, text, "a"), (2, "nothing", "b")], "doc_id long, text string, source string")
    start = time.time()
    found = secret_scan.scanned(docs, with_text=True)
    spans, out = found.select("_spans", secret_scan.redacted(F.col("_doc.text"), F.col("_spans")).alias("t")).orderBy(-F.size("_spans")).first()
    assert [(s.start, s.end) for s in spans] == [m.span() for m in re.finditer("[0-9a-f]{32,}", text)]
    assert out == " ".join("[SECRET] é" for _ in range(100_000)) and time.time() - start < 60
