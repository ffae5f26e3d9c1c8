"""Region assembly, scripts and geometry with pieces made by hand."""

import pytest

from texmill.functions.assembly import Piece, region
from texmill.operators import layout as ops


def piece(text, x, y, wide=6, size=10.0, font="CMMI10"):
    return Piece(text, (x, y - 0.8 * size, x + wide, y + 0.2 * size), size, y, font)


def tall(text, x):
    return Piece(text, (x, 80, x + 4, 125), 10, 100, "CMEX10")


GRID = [piece("a", 12, 90), piece("b", 40, 90), piece("c", 12, 115), piece("d", 40, 115)]


@pytest.mark.parametrize(
    ("pieces", "bars", "latex"),
    [
        ([piece("a", 20, 90), piece("b", 20, 112)], [(15, 96, 35, 96.5)], r"\frac{a}{b}"),
        ([piece("x", 10, 100), piece("i", 16, 103, 4, 7.0), piece("2", 16, 96, 4, 7.0)], [], "x_{i}^{2}"),
        ([piece("e", 10, 100), piece("x", 16, 96, 5, 7.0), piece("2", 21, 93, 3, 5.0)], [], "e^{x^{2}}"),
        ([piece("∑", 10, 100, 10), piece("i=1", 8, 113, 14, 7.0), piece("n", 13, 87, 4, 7.0), piece("x", 24, 100)], [], r"\sum_{i=1}^{n}x"),
        ([piece("√", 8, 110), piece("x", 15, 110)], [(14, 100, 24, 100.4)], r"\sqrt{x}"),
        ([piece("y", 10, 100), piece("=", 20, 100), piece("a", 32, 93), piece("b", 32, 107)], [], r"y=\frac{a}{b}"),
        ([tall("(", 5), *GRID, tall(")", 50)], [], r"\begin{pmatrix} a & b \\ c & d \end{pmatrix}"),
        ([tall("{", 5), *GRID], [], r"\begin{cases} a & b \\ c & d \end{cases}"),
        ([piece("ˆ", 11, 94, 4), piece("X", 10, 100)], [], r"\hat{X}"),
        ([piece("a", 10, 100), piece("b", 10, 125)], [], r"\begin{aligned} a \\ b \end{aligned}"),
        ([piece("x", 10, 100), piece("(5)", 100, 100, 12)], [], "x"),
        ([piece("E", 10, 100, font="MSBM10")], [], r"\mathbb{E}"),
        ([], [], None),
    ],
)
def test_region(pieces, bars, latex):
    assert region(pieces, bars) == latex


def test_bar_joins_equal_nested_loops(spark):
    spans = [(1, 0, i, 0, "a", "CMMI10", 10.0, float(i % 9 * 7), float(i * 11 % 500)) for i in range(120)]
    df = spark.createDataFrame(spans, "doc_id int, page_no int, line_no int, span_no int, text string, font string, size double, x0 double, y0 double").selectExpr("*", "x0 + 8 as x1", "y0 + 10 as y1", "y0 + 8 as oy", "0 as flags")
    bars = spark.createDataFrame([(1, 0, i, float(i % 5 * 9), float(i * 13 % 480), 20.0 + i % 5 * 9, float(i * 13 % 480) + 0.5) for i in range(80)], "doc_id int, page_no int, bar_no int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.bar_no, r.line_no, r.side) for r in ops.bar_sides(ops.bars(bars), ops.lines(df)).collect()}
    want = set()
    for b in bars.collect():
        for s in df.collect():
            mid, shared = (b.y0 + b.y1) / 2, min(s.x1, b.x1) - max(s.x0, b.x0)
            if shared <= 0 or shared < 0.6 * min(b.x1 - b.x0, 8) or 8 > 1.3 * (b.x1 - b.x0):
                continue
            if 0 <= mid - s.y1 < 14:
                want.add((b.bar_no, s.line_no, "above"))
            elif 0 <= s.y0 - mid < 14:
                want.add((b.bar_no, s.line_no, "below"))
    assert got == want and got


def test_baseline_with_no_dominant_size(spark):
    rows = [(1, 0, 0, i, "a", float(s), 1.0) for i, s in enumerate((5, 6, 7, 8, 9, 10))]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, line_no int, span_no int, text string, size double, oy double")
    assert ops.baselines(df).first().base_size == 10.0


def test_bag_agreement_counts_copies(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "c"]), (2, [], []), (3, ["x"], [])], "k int, a array<string>, b array<string>")
    assert {r.k: r.agreement for r in ops.bag_agreement(df, "k").collect()} == {1: 0.4, 2: 0.0, 3: 0.0}
