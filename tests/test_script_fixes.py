"""Scripts of lines with mixed fonts against a plain loop."""

from collections import defaultdict

from pyspark.sql import functions as F

from texmill import registry
from texmill.plans import corpus

SF = "/root/testdata/sf0.001"


def fixes(spans):
    """(span_no, plain, latex) of one line's spans, in order."""
    spans = [s for s in spans if s.text.strip()]
    weight, found = defaultdict(int), []
    for s in spans:
        weight[s.size] += len(s.text.strip())
    base = max(weight, key=lambda k: (weight[k] >= 0.2 * sum(weight.values()), k))
    ys = sorted(s.oy for s in spans if s.size == base)
    base_y = ys[len(ys) // 2]
    kind = lambda s: None if s.size >= base - 0.4 else "^" if s.oy - base_y < -0.14 * base else "_" if s.oy - base_y > 0.08 * base else None
    for i, s in enumerate(spans):
        if kind(s):
            continue
        hung = []
        for t in spans[i + 1 :]:
            if not kind(t):
                break
            hung.append(t)
        word = "" if s.text[-1:].isspace() else s.text.split()[-1]
        texts = [t.text.strip() for t in hung]
        plain = word + "".join(texts)
        if hung and word and len(plain) >= 2 and not plain.isdigit() and max(map(len, texts)) <= 12:
            found.append((s.span_no, plain, "$" + word + "".join(f"{kind(t)}{{{x}}}" for t, x in zip(hung, texts, strict=True)) + "$"))
    return found


def test_lines_of_mixed_fonts(spark):
    lines, fonts = defaultdict(list), {}
    for s in corpus.rows(spark, SF, "spans").withColumn("size", F.col("size").cast("double")).collect():
        lines[s.doc_id, s.page_no, s.line_no].append(s)
        fonts[s.doc_id, s.page_no, s.line_no, s.span_no] = s.font
    want = {(*key, *x) for key, spans in lines.items() for x in fixes(sorted(spans, key=lambda s: (s.x0, s.span_no)))}
    got = registry.QUERIES["script_fixes"](spark, SF).select("doc_id", "page_no", "line_no", "span_no", "plain", "latex").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {fonts[tuple(r)[:4]] for r in got} == {"CMMI10", "CMR10", "CMTT9"}
