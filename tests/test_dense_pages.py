"""Geometry of crowded pages, odd boxes and repeated numbers against nested loops, and how many rows a plan makes for them."""

import random
import time

from pyspark.sql import functions as F

from texmill.operators import layout as geometry, regions as ops

BOXES = "doc_id int, page_no int, {} int, x0 double, y0 double, x1 double, y1 double"


def boxes(n, seed, name="line_no", wide=30, tall=3):
    """Boxes of few heights, some empty, some turned around, some repeated, some without an edge."""
    rng, out = random.Random(seed), []
    for i in range(n):
        x, y = float(rng.randrange(200)), float(rng.randrange(30) * 14)
        out.append((i % 2, 0, i, x, y, x + rng.randrange(-4, wide), y + rng.randrange(-1, tall) if rng.random() < 0.9 else None))
    return out + [(*out[5][:2], n, *out[5][3:])]


def touch(a, b):
    return None not in (*a, *b) and a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1]


def test_untouched_equals_nested_loops(spark):
    items, regions = boxes(300, 1), boxes(120, 2, wide=60, tall=40)
    got = geometry.untouched(spark.createDataFrame(items, BOXES.format("line_no")), spark.createDataFrame(regions, BOXES.format("no")))
    want = [i for i in items if not any(i[:2] == r[:2] and touch(i[3:], r[3:]) for r in regions)]
    assert sorted(r.line_no for r in got.collect()) == [i[2] for i in want] and 20 < len(want) < 280


def test_regions_of_a_height_are_few(spark):
    """A page of 4,000 regions of one height keeps those that no other one holds."""
    found = geometry.outermost(spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page_no"), (F.col("id") % 50).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") % 50 + F.col("id") % 3).cast("double").alias("x1"), F.lit(9.0).alias("y1")))
    assert found.count() == 50 and found.filter("x1 - x0 < 2").count() == 0


def test_folds_equal_plain_loops(spark):
    """Clusters and their rows, with missing edges and texts."""
    lines = [(*b, None if b[2] % 7 == 3 else f"t{b[2] % 5}") for b in boxes(200, 3, wide=9, tall=9)]
    df = spark.createDataFrame(lines, BOXES.format("line_no") + ", text string")
    skip = lambda pick, *v: pick((x for x in v if x is not None), default=None)
    want, page, k = {}, None, 0
    null_first = lambda r: [(x is not None, x or 0) for x in (*r[:2], r[4], r[3], r[2])]
    for r in sorted(lines, key=null_first):
        b = r[3:7]
        if r[:2] != page:
            page, k, a = r[:2], 0, None
        near = a and None not in (a[3], b[1]) and b[1] - a[3] < 14 and skip(min, a[2], b[2]) is not None and skip(min, a[2], b[2]) - skip(max, a[0], b[0]) > -18
        a, k = ([skip(p, x, y) for p, x, y in zip((min, min, max, max), a, b)], k) if near else (b, k + 1)  # noqa: B905
        want[r[:3]] = k
    found = ops.clusters(df, "text")
    assert {(r.doc_id, r.page_no, r.line_no): r.cluster for r in found.collect()} == want and 4 < len(set(want.values())) < 100
    told = {(r.doc_id, r.page_no, r.cluster): r.latex for r in ops.collapsed(found.withColumnRenamed("text", "latex")).collect()}
    for key in set(told) | {(*k[:2], n) for k, n in want.items()}:
        own, rows = sorted((r[4], r[3], r[7] is not None, r[7] or "") for r in lines if (*r[:2], want[r[:3]]) == key), []
        for y, *item in own:
            if not rows or abs(y - first) >= 6:
                rows, first = [*rows, []], y
            rows[-1].append(item)
        text = [" ".join(t for _, there, t in sorted(row) if there) for row in rows]
        assert told[key] == (text[0] if len(text) == 1 else r"\begin{aligned} " + r" \\ ".join(text) + r" \end{aligned}")


def test_crowded_page_folds_in_one_pass(spark):
    """A page of 150,000 lines: a fold that copies what it has would take minutes."""
    start = time.perf_counter()
    n = F.col("id")
    page = spark.range(150_000).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page_no"), n.alias("line_no"), *((n % m).cast("double").alias(c) for c, m in (("x0", 90), ("y0", 700))))
    page = page.selectExpr("*", "x0 + 9 as x1", "y0 + 9 as y1", "'a' as text")
    told = ops.collapsed(ops.clusters(page, "text").withColumnRenamed("text", "latex")).collect()
    assert len(told) == 1 and told[0].latex.count("a") == 150_002 and time.perf_counter() - start < 60


def crowded(spark):
    """Lines of few heights and bars between them, some numbers of bars and lines repeated or null."""
    rng, lines, bars = random.Random(8), [], []
    for i in range(240):
        x, y = float(rng.randrange(60)), float(rng.randrange(12) * 14)
        lines.append((1, i % 2, i if i % 40 else (None if i == 40 else i), x, y, x + rng.randrange(8, 60), y + 10, i % 3 == 0, f" t{i} "))
        bars.append((1, i % 2, None if i == 7 else i // 2, float(rng.randrange(40)), y + 11, float(rng.randrange(45, 100)), y + 11.0 + rng.randrange(3)))
    made = BOXES.format("line_no") + ", math boolean, text string"
    return lines, bars, spark.createDataFrame(lines, made), spark.createDataFrame(bars, BOXES.format("bar_no"))


def side(line, bar):
    (x0, y0, x1, y1), (a, top, c, low) = line, bar
    shared, mid, far = min(x1, c) - max(x0, a), (top + low) / 2, 1.4 * max(6.0, y1 - y0)
    if shared <= 0 or shared < 0.6 * min(x1 - x0, c - a) or x1 - x0 > 1.3 * (c - a):
        return None
    return ("above", mid - y1) if 0 <= mid - y1 < far else ("below", y0 - mid) if 0 <= y0 - mid < far else None


def test_intruders_and_texts_equal_nested_loops(spark):
    lines, bars, line_rows, bar_rows = crowded(spark)
    regions, own = {}, set()
    for b in bars:
        for n in lines:
            if n[:2] == b[:2] and (s := side(n[3:7], b[3:])):
                regions.setdefault(b[:3], []).append((*s, n))
                own |= {(*b[:3], n[2])} if None not in (b[2], n[2]) else set()
    boxes = {}
    for key, found in regions.items():
        up, down = ([g for s, g, _ in found if s == k] for k in ("above", "below"))
        if up and down and any(n[7] for *_, n in found) and abs(min(up) - min(down)) <= max(min(up), min(down), 1.0) * 0.65 + 1.5:
            boxes[key] = [p(n[i] for *_, n in found) for i, p in ((3, min), (4, min), (5, max), (6, max))]
    got = geometry.fraction_regions(bar_rows, line_rows, with_bars=True)
    assert {(r.doc_id, r.page_no, r.bar_no): [r.x0, r.y0, r.x1, r.y1] for r in got.collect()} == boxes and boxes
    order = lambda rows: sorted(map(repr, rows))
    strange = [(*k, n[2]) for k, b in boxes.items() for n in lines if n[:2] == k[:2] and touch(n[3:7], b) and (*k, n[2]) not in own]
    assert order(tuple(r) for r in ops.intruders(got, line_rows).collect()) == order(strange) and strange
    inside = lambda n, b: n[3] >= b[0] - 2 and n[5] <= b[2] + 2 and n[4] >= b[1] - 2 and n[6] <= b[3] + 2
    told = [(*k, "".join(n[8].strip() for n in sorted(lines, key=lambda n: (n[2] is not None, n[2] or 0)) if n[:2] == k[:2] and inside(n, b))) for k, b in boxes.items()]
    assert order(tuple(r) for r in ops.region_texts(got, line_rows).collect()) == order(told)


def test_pairs_of_lines_and_regions_are_not_shuffled(spark):
    """What grows with the square of a page, pairs and texts of regions, passes no exchange after the lines and regions met."""
    _, _, lines, bars = crowded(spark)
    regions = geometry.fraction_regions(bars, lines, with_bars=True)
    plan = ops.intruders(regions, lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join Inner")] and "LeftAnti" not in plan
    plan = ops.region_texts(regions, lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("MapInArrow")] and "Join" not in plan[: plan.index("MapInArrow")]
