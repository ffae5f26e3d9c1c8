"""Rows of all documents against plain Python."""

from collections import defaultdict

from texmill import registry
from texmill.plans import corpus

SF = "/root/testdata/sf0.001"


def test_rows_of_every_document(spark):
    pages = defaultdict(list)
    for s in corpus.rows(spark, SF, "spans").collect():
        pages[s.doc_id, s.page_no].append(s)
    want = set()
    for key, spans in pages.items():
        bases = []
        for y in sorted(s.oy for s in spans):
            if not bases or y - bases[-1] > 9.0:
                bases.append(y)
        want |= {(*key, s.line_no, s.span_no, min(range(len(bases)), key=lambda k: (abs(bases[k] - s.oy), k))) for s in spans}  # noqa: B023
    got = registry.QUERIES["row_nearest"](spark, SF).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len({r.doc_id for r in got}) == 30
