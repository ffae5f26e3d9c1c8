"""Warnings of whole logs against plain Python, with and without lines that continue a warning."""

from collections import defaultdict

from texmill import registry
from texmill.operators import documents as ops
from texmill.plans import corpus

SF = "/root/testdata/sf0.001"
MATH = "Could not convert TeX math"


def counted(lines):
    parts = [[]]
    for line in lines:
        if line.startswith("[WARNING]"):
            parts.append([])
        parts[-1].append(line)
    filled = [p for p in ("\n".join(p) for p in parts) if p.strip()]
    return sum(MATH in p for p in filled), sum(MATH not in p for p in filled)


def logs(rows):
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        found[r[0]].append(r[2])
    return {k: counted(v) for k, v in found.items()}


def test_warnings_after_line_60(spark):
    lines = [(r.doc_id, r.line_no, r.line) for r in corpus.rows(spark, "/root/testdata/sf0.01", "log_lines").collect()]
    got = {r.doc_id: (r.formulas, r.others) for r in registry.QUERIES["converter_warnings"](spark, "/root/testdata/sf0.01").collect()}
    assert got == logs(lines) and sum(n for n, _ in got.values()) == sum(x[2].startswith("[WARNING]") for x in lines)


def test_parts_of_a_log(spark):
    rows = [(1, i, x) for i, x in enumerate(["", " ", "[WARNING] other", "more", "[WARNING] x", f"  {MATH} here", f"[WARNING] {MATH}"] * 30)]
    rows += [(2, 1, "head"), (2, 2, " [WARNING] not at the start"), (3, 1, " ")]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, line string")
    got = {r.doc_id: (r.formulas, r.others) for r in ops.converter_warning_counts(df).collect()}
    assert got == logs(rows) == {1: (60, 30), 2: (0, 1), 3: (0, 0)}
