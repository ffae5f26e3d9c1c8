"""Errors, regions and headings of all rows against plain Python."""

import re
from collections import defaultdict

from texmill import registry
from texmill.plans import analytics, corpus, markdown

SF = "/root/testdata/sf0.001"


def test_errors_of_every_document(spark):
    logs, want = defaultdict(list), {}
    for r in corpus.rows(spark, SF, analytics._ERROR_LINES).collect():
        logs[r.doc_id].append((r.line_no, r.line))
    for doc, lines in logs.items():
        found = [(n, x) for n, x in lines if (m := re.match(r"[^\s:]+\.\w+:\d+: (.+)$", x)) and not re.match("warning|info", m[1].strip().lower())]
        found = found or [(n, x[2:]) for n, x in lines if re.match("! .+$", x)]
        found += [(n + 1_000_000_000, "missing package: " + m[1]) for n, x in lines if (m := re.search(r"File `([^']+\.sty)' not found", x))]
        for n, message in found:
            want[doc, message] = min(n, want.get((doc, message), n))
    got = registry.QUERIES["compile_errors"](spark, SF).collect()
    assert {(r.doc_id, r.message): r.place for r in got} == want and len(got) == len(want)
    assert {r.doc_id % 2 for r in got if r.message.startswith("./main.tex")} == {0} and any(r.doc_id % 2 for r in got)


def test_regions_of_every_drawing(spark):
    drawn, within, clear = defaultdict(list), set(), set()
    for d in corpus.rows(spark, SF, "drawings").collect():
        drawn[d.doc_id, d.page_no].append((d.x0, d.y0 - 20, d.x1 + 60, d.y0 + 25))
    for s in corpus.rows(spark, SF, "spans").collect():
        regions, key = drawn[s.doc_id, s.page_no], (s.doc_id, s.page_no, s.line_no, s.span_no)
        if any(s.x0 >= a - 2 and s.x1 <= c + 2 and s.y0 >= b - 2 and s.y1 <= d + 2 for a, b, c, d in regions):
            within.add(key)
        if not any(s.x0 < c and s.x1 > a and s.y0 < d and s.y1 > b for a, b, c, d in regions):
            clear.add(key)
    rows = {n: registry.QUERIES[n](spark, SF).collect() for n in ("contains_semi", "overlap_anti")}
    got = {n: {tuple(r) for r in found} for n, found in rows.items()}
    assert got["contains_semi"] == within and got["overlap_anti"] == clear and within and clear and all(len(got[n]) == len(rows[n]) for n in rows)


def test_headings_of_every_line(spark):
    docs, want = defaultdict(list), {}
    for r in corpus.rows(spark, SF, markdown._WORDS).collect():
        docs[r.doc_id].append((r.line_no, r.text.split(" ")))
    for doc, lines in docs.items():
        lines.sort()
        runs = [sum((w for _, w in lines[i : i + n]), []) for n in (1, 2, 3) for i in range(len(lines) - n + 1)]
        for line_no, words in lines:
            title = next((r for r in runs if sorted(r) == sorted(words) and r != words[::-1]), None)
            if title:
                want[doc, line_no] = " ".join(title)
    got = registry.QUERIES["bag_equal_reorder"](spark, SF).collect()
    assert {(r.doc_id, r.heading_no): r.title for r in got} == want and any(r.heading_no % 3 for r in got)
