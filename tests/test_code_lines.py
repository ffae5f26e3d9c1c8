"""Lines of listings against a plain loop over their chunks."""

from collections import defaultdict

from texmill import registry
from texmill.operators import regions as ops
from texmill.plans import corpus, regions

SF = "/root/testdata/sf0.001"


def line_of(chunks, first, pitch):
    out, z = "", 0.0
    for chunk in sorted(chunks, key=lambda c: (c[0][1], c[-1][1], "".join(x for x, _ in c))):
        if out:
            column = max(len(out), len(out) - 1 + round((chunk[0][1] - z) / pitch))
        else:
            column = max(0, round((chunk[0][1] - first) / pitch))
        out, z = out.ljust(column) + "".join(c for c, _ in chunk), chunk[-1][1]
    return out


def lines(rows):
    pages = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for r in sorted(rows, key=lambda r: r.i):
        pages[r.doc_id, r.page_no][r.line_no][r.chunk].append((r.c, (r.x0 + r.x1) / 2))
    for page, found in pages.items():
        gaps = sorted(b[1] - a[1] for line in found.values() for c in line.values() for a, b in zip(c, c[1:]) if b[1] > a[1])  # noqa: B905
        first = min(m for line in found.values() for c in line.values() for x, m in c if x.strip())
        for no, line in found.items():
            chunks = []
            for c in line.values():
                filled = [k for k, (x, _) in enumerate(c) if x.strip()]
                if filled:
                    chunks.append(c[filled[0] : filled[-1] + 1])
            if chunks and gaps:
                yield (*page, no, line_of(chunks, first, gaps[len(gaps) // 2]))


def test_lines_of_every_page(spark):
    want = set(lines(corpus.rows(spark, SF, regions._LETTERS).collect()))
    got = registry.QUERIES["code_lines"](spark, SF).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_columns_and_blanks(spark):
    text = ["  def f(x):", "      return x", "", "y"]
    rows = [(1, 1, n, 0, i, c, 10.0 + 6 * i, 16.0 + 6 * i, 12.0 * n) for n, t in enumerate(text) for i, c in enumerate(t)]
    chars = spark.createDataFrame(rows, "doc_id int, page_no int, line_no int, chunk int, i int, c string, x0 double, x1 double, y double")
    grid = ops.grid(chars, ["doc_id", "page_no"], "line_no")
    assert [tuple(r)[2:] for r in grid.collect()] == [(6.0, 13.0, 12.0)]
    got = ops.code_lines(chars, grid, ["doc_id", "page_no"], "line_no").orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in got] == [(0, "  def f(x):"), (1, "      return x"), (3, "y")]
