"""Joins and islands of glyph geometry.

Joins are by page and by bands of y: the side that reaches further is put into each band it touches, the other into the one
of its centre, so no pair comes twice and no page becomes one large product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from texmill.functions import layout as f

PAGE = ["doc_id", "page_no"]
LINE = [*PAGE, "line_no"]
BOX = ("x0", "y0", "x1", "y1")
BAND = 64.0


def _reach(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    return rows.withColumn("_band", F.explode(F.sequence(F.floor(low / BAND), F.floor(high / BAND))))


def _at(rows: DataFrame, y: Column) -> DataFrame:
    return rows.withColumn("_band", F.floor(y / BAND))


def bars(drawings: DataFrame) -> DataFrame:
    return drawings.filter(f.bar(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


def union_rect(rows: DataFrame, *keys: str) -> DataFrame:
    """The box around all boxes of each group."""
    return rows.groupBy(*keys).agg(*(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1")))


def baselines(spans: DataFrame) -> DataFrame:
    """(LINE, base_size, base_y): the largest size with a fifth of the line's letters, and its upper median baseline.
    Where no size has a fifth, the largest."""
    filled = spans.filter(F.trim("text") != "").withColumn("s", F.bround("size", 1))
    weights = filled.groupBy(*LINE, "s").agg(F.sum(F.length(F.trim("text"))).alias("n"), F.sort_array(F.collect_list("oy")).alias("ys"))
    total = Window.partitionBy(*LINE)
    sized = weights.withColumn("all", F.sum("n").over(total))
    pick = F.max_by(F.struct("s", "ys"), F.struct((F.col("n") >= 0.2 * F.col("all")), "s"))
    out = sized.groupBy(*LINE).agg(pick.alias("p"))
    return out.select(*LINE, F.col("p.s").alias("base_size"), F.get("p.ys", F.floor(F.size("p.ys") / 2).cast("int")).alias("base_y"))


def math_ratio(spans: DataFrame) -> DataFrame:
    """(LINE, decisive, math): letters that tell whether a line is mathematics, and those of them in mathematical fonts."""
    n = F.length(F.regexp_replace("text", f.NEUTRAL, ""))
    return spans.groupBy(*LINE).agg(F.sum(n).alias("decisive"), F.sum(F.when(f.math_font(F.col("font")), n).otherwise(0)).alias("math"))


def scripts(spans: DataFrame) -> DataFrame:
    """spans with kind: sup, sub or null."""
    kind = f.script_kind(F.col("size"), F.col("oy"), F.col("base_size"), F.col("base_y"))
    return spans.join(baselines(spans), LINE).withColumn("kind", kind).drop("base_size", "base_y")


def false_superscripts(spans: DataFrame) -> DataFrame:
    """Spans marked as superscripts for which an unmarked one of the page has the same size and baseline."""
    marked = F.col("flags").bitwiseAND(F.lit(1)) == 1
    plain = spans.filter(~marked & (F.trim("text") != "")).select(*PAGE, F.col("size").alias("n_size"), F.col("oy").alias("n_y")).distinct()
    flagged = spans.filter(marked & ~f.extension_font(F.col("font")))
    left = _reach(flagged, F.col("oy") - 0.15 * F.col("size") - 1, F.col("oy") + 0.15 * F.col("size") + 1)
    right = _at(plain, F.col("n_y"))
    near = (F.abs(F.col("n_size") - F.col("size")) < 0.4) & (F.abs(F.col("n_y") - F.col("oy")) < 0.12 * F.col("n_size"))
    same = [left[c] == right[c] for c in (*PAGE, "_band")]
    return left.join(right, [*same, near], "left_semi").drop("_band").dropDuplicates([*LINE, "span_no"])


def chains(items: DataFrame, keys: list[str], gap: Column | float) -> DataFrame:
    """items with chain (from 1): runs in which each begins less than gap right of where all before it end."""
    w = Window.partitionBy(*keys).orderBy("x0", "x1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col("x0") - before >= gap), 1).otherwise(0)
    return items.withColumn("_starts", starts).withColumn("chain", F.sum("_starts").over(w)).drop("_starts")


def row_bases(items: DataFrame, keys: list[str], height: Column | float) -> DataFrame:
    """(keys, bases): a new row begins where a baseline lies over 0.9 of a height below the base that the last row began with."""
    ys = F.sort_array(F.collect_list("oy"))
    fold = F.aggregate("ys", F.array().cast("array<double>"), lambda acc, y: F.when(F.size(acc) == 0, F.array(y)).otherwise(F.when(y - F.try_element_at(acc, F.lit(-1)) > 0.9 * height, F.concat(acc, F.array(y))).otherwise(acc)))
    return items.groupBy(*keys).agg(ys.alias("ys")).select(*keys, fold.alias("bases"))


def nearest_rows(items: DataFrame, keys: list[str], height: float) -> DataFrame:
    """items with row: the place of the nearest base of their group, the first on ties."""
    bases = row_bases(items, keys, height)
    gaps = F.transform("bases", lambda b, i: F.struct(F.abs(b - F.col("oy")).alias("gap"), i.alias("i")))
    return items.join(bases, keys).withColumn("row", F.array_min(gaps)["i"]).drop("bases")


def lines(spans: DataFrame) -> DataFrame:
    """Boxes of lines, whether a mathematical font is in them, and their text in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "")
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return spans.groupBy(*LINE).agg(*box, F.bool_or(f.math_font(F.col("font"))).alias("math"), text.alias("text"))


def paired(left: DataFrame, right: DataFrame, low: Column, high: Column, near: Column) -> DataFrame:
    """Rows of left(PAGE, y0, y1) and right(PAGE, by0, by1) of a page, each two once, whose heights are near.

    Heights meet first, by bands that left's reaches from low to high, so that rows meet only those of near heights."""
    a = _reach(left.select(*PAGE, "y0", "y1").distinct(), low, high)
    b = _reach(right.select(*PAGE, "by0", "by1").distinct(), F.col("by0"), F.col("by1"))
    heights = a.join(b, [*PAGE, "_band"]).filter(near).select(*PAGE, "y0", "y1", "by0", "by1").distinct()
    n, keys = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*PAGE, "by0", "by1"]
    return left.join(heights, [*PAGE, "y0", "y1"]).repartition(n, *keys).join(right.repartition(n, *keys), keys)  # few bytes, many pairs


def sides(bar: Callable[[str], Column]) -> tuple[Column, Column, Column]:
    """Whether a line (x0, y0, x1, y1) fits a bar with those edges, its side (null: too far), and its gap."""
    tall = F.greatest(F.lit(6.0), F.col("y1") - F.col("y0"))
    mid = (bar("y0") + bar("y1")) / 2
    wide, bar_wide = F.col("x1") - F.col("x0"), bar("x1") - bar("x0")
    shared = F.least(F.col("x1"), bar("x1")) - F.greatest(F.col("x0"), bar("x0"))
    fits = (shared > 0) & (shared >= 0.6 * F.least(wide, bar_wide)) & (wide <= 1.3 * bar_wide)
    above, below = mid - F.col("y1"), F.col("y0") - mid
    side = F.when((above >= 0) & (above < 1.4 * tall), "above").when((below >= 0) & (below < 1.4 * tall), "below")
    return fits, side, F.when(side == "above", above).otherwise(below)


def _sided(found: DataFrame, boxes: DataFrame) -> DataFrame:
    """found(PAGE, b + BOX) and boxes(PAGE, BOX) of lines that may be numerator or denominator, with side and gap."""
    tall = F.greatest(F.lit(6.0), F.col("y1") - F.col("y0"))
    fits, side, gap = sides(lambda c: F.col("b" + c))
    pairs = paired(boxes, found, F.col("y0") - 1.4 * tall, F.col("y1") + 1.4 * tall, side.isNotNull())
    return pairs.filter(fits).withColumns({"side": side, "gap": gap})


def bar_sides(found: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines above and below bars that may be numerator and denominator: (PAGE, bar_no, line_no, side, gap, math)."""
    pairs = _sided(found.select(*PAGE, "bar_no", *(F.col(c).alias("b" + c) for c in BOX)), boxes)
    return pairs.select(*PAGE, "bar_no", "line_no", "side", "gap", "math", *BOX)


def fraction_regions(found: DataFrame, boxes: DataFrame, with_bars: bool = False) -> DataFrame:
    """(PAGE, bar_no, box of both sides): bars with lines on both sides at about equal gaps, some in a mathematical font.
    with_bars: also bars, the boxes of that number which have lines. Equal bars and equal lines meet once."""
    bar = [F.col(c).alias("b" + c) for c in BOX]
    shapes = boxes.groupBy(*PAGE, *BOX).agg(F.bool_or("math").alias("math"))
    pairs = _sided(found.select(*PAGE, *bar).distinct(), shapes)
    up, down = (F.min(F.when(F.col("side") == s, F.col("gap"))) for s in ("above", "below"))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    math = F.bool_or("math").alias("math")
    each = pairs.groupBy(*PAGE, *("b" + c for c in BOX)).agg(up.alias("up"), down.alias("down"), math, *box)
    named = found.select(*PAGE, "bar_no", *bar).join(each, [*PAGE, *("b" + c for c in BOX)])
    bars_ = [F.collect_set(F.struct(*(F.col("b" + c).alias(c) for c in BOX))).alias("bars")] if with_bars else []
    out = named.groupBy(*PAGE, "bar_no").agg(F.min("up").alias("up"), F.min("down").alias("down"), math, *box, *bars_)
    even = F.abs(F.col("up") - F.col("down")) <= F.greatest("up", "down", F.lit(1.0)) * 0.65 + 1.5
    return out.filter(F.col("up").isNotNull() & F.col("down").isNotNull() & even & F.col("math")).drop("math")


def nearest_limits(spans: DataFrame) -> DataFrame:
    """(PAGE, op_line, op_span, line_no, span_no, side): each smaller span at the operator nearest above or below it."""
    op = spans.withColumn("command", f.operator(F.col("text"), F.col("font"))).filter("command is not null and command <> '\\\\int'")
    op = op.select(*PAGE, F.col("line_no").alias("op_line"), F.col("span_no").alias("op_span"), "command", F.col("size").alias("op_size"), *(F.col(c).alias("o" + c) for c in ("x0", "y0", "x1", "y1")))
    tall = F.col("oy1") - F.col("oy0")
    left = _reach(op, F.col("oy0") - 1.6 * tall, F.col("oy1") + 1.6 * tall)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    right = _at(spans.select(*LINE, "span_no", "size", "x0", "y0", "x1", "y1"), cy)
    pairs = left.join(right, [*PAGE, "_band"]).withColumn("cx", cx).withColumn("cy", cy).filter(F.col("size") <= F.col("op_size") - 0.4)
    below = (F.col("cy") > F.col("oy1") - 0.2 * tall) & (F.col("cy") < F.col("oy1") + 1.6 * tall)
    above = (F.col("cy") > F.col("oy0") - 1.6 * tall) & (F.col("cy") < F.col("oy0") + 0.2 * tall)
    side = F.when(below, "below").when(above, "above")
    wide = F.col("ox1") - F.col("ox0")
    margin = F.when(side == "below", wide).otherwise(0.3 * wide)
    gap = F.when(side == "below", F.greatest(F.lit(0.0), F.col("cy") - F.col("oy1"))).otherwise(F.greatest(F.lit(0.0), F.col("oy0") - F.col("cy")))
    near = pairs.withColumn("side", side).filter(F.col("side").isNotNull() & F.col("cx").between(F.col("ox0") - margin, F.col("ox1") + margin))
    away = F.abs(F.col("cx") - (F.col("ox0") + F.col("ox1")) / 2) + gap
    best = near.groupBy(*LINE, "span_no").agg(F.min_by(F.struct("op_line", "op_span", "command", "side"), F.struct(away, "op_line", "op_span")).alias("b"))
    return best.select(*LINE, "span_no", "b.*")


def accent_bases(spans: DataFrame) -> DataFrame:
    """(LINE, span_no, base_line, base_span, letter): the letter, by place, of the span under each accent."""
    marked = spans.withColumn("command", f.accent(F.col("text")))
    a = marked.filter("command is not null").select(*LINE, "span_no", "command", ((F.col("x0") + F.col("x1")) / 2).alias("ax"), ((F.col("y0") + F.col("y1")) / 2).alias("ay"), F.col("y1").alias("a_y1"), F.greatest(F.lit(1.0), 0.3 * F.col("size")).alias("slack"))
    b = marked.filter("command is null").select(*PAGE, F.col("line_no").alias("base_line"), F.col("span_no").alias("base_span"), F.trim("text").alias("base"), "size", "x0", "y0", "x1", "y1")
    left = _reach(b, F.col("y0") - 0.5 * F.col("size") - 20, F.col("y1") + 20)
    right = _at(a, F.col("ay"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    under = F.col("ax").between(F.col("x0") - 1, F.col("x1") + 1) & (cy >= F.col("ay") - F.col("slack")) & (F.col("y1") >= F.col("a_y1") - F.col("slack")) & (F.col("y0") - F.col("a_y1") < 0.5 * F.col("size"))
    pairs = right.join(left, [*PAGE, "_band"]).filter(under & (F.col("base") != ""))
    share = F.floor((F.col("ax") - F.col("x0")) / ((F.col("x1") - F.col("x0")) / F.length("base")))
    letter = F.greatest(F.lit(0), F.least(F.length("base") - 1, share)).cast("int")
    order = F.struct(cy - F.col("ay"), F.abs(cx - F.col("ax")), "base_line", "base_span")
    best = pairs.groupBy(*LINE, "span_no").agg(F.min_by(F.struct("base_line", "base_span", letter.alias("letter"), "command"), order).alias("b"))
    return best.select(*LINE, "span_no", "b.*")


def contained(items: DataFrame, regions: DataFrame, slack: float = 2.0) -> DataFrame:
    """items whose box lies in a region of their page, but for slack."""
    i = _at(items.select("*", *(F.col(c).alias("i" + c) for c in ("x0", "y0", "x1", "y1"))), F.col("y0"))
    r = _reach(regions.select(*PAGE, *(F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1"))), F.col("ry0") - slack, F.col("ry1") + slack)
    return i.join(r, [*(i[c] == r[c] for c in (*PAGE, "_band")), f.inside("i", "r", slack)], "left_semi").drop("_band", "ix0", "iy0", "ix1", "iy1")


def outermost(boxes: DataFrame) -> DataFrame:
    """(PAGE, BOX) of boxes, without those that one of the same height holds: what overlaps any of them overlaps one that is kept."""
    filled = boxes.select(*PAGE, *BOX).filter(" and ".join(f"{c} is not null" for c in BOX))
    wide = filled.groupBy(*PAGE, "x0", "y0", "y1").agg(F.max("x1").alias("x1"))
    before = F.max("x1").over(Window.partitionBy(*PAGE, "y0", "y1").orderBy("x0").rowsBetween(Window.unboundedPreceding, -1))
    return wide.withColumn("_before", before).filter("_before is null or x1 > _before").select(*PAGE, *BOX)


def untouched(items: DataFrame, regions: DataFrame) -> DataFrame:
    """items whose box overlaps no region of their page; equal boxes are asked once."""
    i = items.select(*PAGE, *(F.col(c).alias("i" + c) for c in BOX)).distinct()
    r = outermost(regions).select(*PAGE, *(F.col(c).alias("r" + c) for c in BOX))
    i, r = _reach(i, F.col("iy0"), F.col("iy1")), _reach(r, F.col("ry0"), F.col("ry1"))
    touching = i.join(r, [*(i[c] == r[c] for c in (*PAGE, "_band")), f.overlap("i", "r")], "left_semi").select(*PAGE, *(F.col("i" + c).alias(c) for c in BOX))
    return items.join(touching, [*PAGE, *BOX], "left_anti")


def code_rows(spans: DataFrame) -> DataFrame:
    """Rows of listings: monospaced spans of a baseline, with block: runs of rows under 3.2 sizes apart, of three or more."""
    m = spans.filter(f.mono(F.col("font"), F.col("flags")) & (F.trim("text") != ""))
    row = m.groupBy(*PAGE, F.bround("oy", 1).alias("y")).agg(F.max("size").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("line"))
    w = Window.partitionBy(*PAGE).orderBy("y")
    starts = F.when(F.lag("y").over(w).isNull() | (F.col("y") - F.lag("y").over(w) >= 3.2 * F.col("size")), 1).otherwise(0)
    blocks = row.withColumn("_s", starts).withColumn("block", F.sum("_s").over(w)).drop("_s")
    n = F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "block"))
    return blocks.withColumn("n_rows", n).filter("n_rows >= 3").drop("size")


def gap_spaces(spans: DataFrame) -> DataFrame:
    """spans with gap_before: over a fifth of their size right of where the span before ends."""
    w = Window.partitionBy(*LINE).orderBy("x0", "span_no")
    return spans.withColumn("gap_before", F.coalesce(F.col("x0") - F.lag("x1").over(w) > 0.2 * F.col("size"), F.lit(False)))


def bag_agreement(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, agreement): twice the shared glyphs of the arrays a and b, as bags, over all of them; 0 if both are empty."""
    each = lambda c: pairs.select(*keys, F.explode(c).alias("glyph")).groupBy(*keys, "glyph").agg(F.count(F.lit(1)).alias("n_" + c))
    shared = each("a").join(each("b"), [*keys, "glyph"]).groupBy(*keys).agg(F.sum(F.least("n_a", "n_b")).alias("shared"))
    total = F.size("a") + F.size("b")
    out = pairs.join(shared, list(keys), "left")
    return out.select(*keys, F.when(total == 0, 0.0).otherwise(2.0 * F.coalesce("shared", F.lit(0)) / total).alias("agreement"))
