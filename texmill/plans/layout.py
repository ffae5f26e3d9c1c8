"""Glyph geometry: bars, baselines, scripts, fractions, limits, accents, islands, containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from texmill.functions import layout as f
from texmill.operators import layout as ops
from texmill.plans import corpus
from texmill.registry import query


def _spans(spark, sf_dir):
    return corpus.rows(spark, sf_dir, "spans")


def _drawings(spark, sf_dir):
    return corpus.rows(spark, sf_dir, "drawings")


_MATH = "font in ('CMMI10')"
_N = r"length(regexp_replace(text, '[()\[\]{}0-9+\-=.,;:!/|<> \t]', '', 'g'))"
_BARS = "bars as (select * from {drawings} where x1 - x0 between 5.0 and 260.0 and y1 - y0 <= 2.2 and x1 - x0 >= 4 * (y1 - y0))"
_BASE = (
    "w as (select doc_id, page_no, line_no, size as s, sum(length(trim(text))) as n, list_sort(list(oy)) as ys from {spans} where trim(text) <> '' group by all), "
    "t as (select *, sum(n) over (partition by doc_id, page_no, line_no) as total from w), "
    "base as (select doc_id, page_no, line_no, p.s as base_size, p.ys[len(p.ys) // 2 + 1] as base_y from (select doc_id, page_no, line_no, arg_max(struct_pack(s, ys), (n >= 0.2 * total, s)) as p from t group by all) x)"
)
_LINES = f"lines as (select doc_id, page_no, line_no, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, bool_or({_MATH}) as math, string_agg(text, '' order by span_no) as text from {{spans}} group by all)"


@query(f"with {_BARS} select doc_id, page_no, bar_no, x0, x1, y0, y1 from bars")
def fraction_bars(spark, sf_dir):
    return ops.bars(_drawings(spark, sf_dir)).select("doc_id", "page_no", "bar_no", "x0", "x1", "y0", "y1")


@query(f"with {_BASE} select * from base")
def body_baseline(spark, sf_dir):
    return ops.baselines(_spans(spark, sf_dir))


@query(f"with {_BASE} select doc_id, page_no, kind, count(*) as n from (select s.*, case when base_size > 0 and size < base_size - 0.4 then case when oy - base_y < -0.14 * base_size then 'sup' when oy - base_y > 0.08 * base_size then 'sub' end end as kind from {{spans}} s join base using (doc_id, page_no, line_no)) x group by all")
def script_kind(spark, sf_dir):
    return ops.scripts(_spans(spark, sf_dir)).groupBy("doc_id", "page_no", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"select doc_id, page_no, line_no, sum({_N})::bigint as decisive, sum(case when {_MATH} then {_N} else 0 end)::bigint as math from {{spans}} group by all")
def math_ratio(spark, sf_dir):
    return ops.math_ratio(_spans(spark, sf_dir))


@query("select font, font = 'CMMI10' as math, font = 'CMTT9' as mono, count(*) as n from {spans} group by all")
def font_roles(spark, sf_dir):
    rows = _spans(spark, sf_dir)
    return rows.groupBy("font", f.math_font(F.col("font")).alias("math"), f.mono(F.col("font"), F.col("flags")).alias("mono")).agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, page_no, bool_or(font = 'CMMI10') as has_math from {spans} group by all")
def font_math_page(spark, sf_dir):
    return _spans(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.bool_or(f.math_font(F.col("font"))).alias("has_math"))


@query("select doc_id, page_no, line_no, span_no from {spans} where font <> 'CMMI10' and len(list_filter(regexp_extract_all(text, '[A-Za-z]{2,}'), lambda w: not list_contains(['max'], w))) > 0")
def text_words(spark, sf_dir):
    return _spans(spark, sf_dir).filter(f.text_word(F.col("text"), F.col("font"))).select("doc_id", "page_no", "line_no", "span_no")


@query(
    "with f as (select * from {spans} where flags % 2 = 1), n as (select distinct doc_id, page_no, size as ns, oy as ny from {spans} where flags % 2 = 0 and trim(text) <> '') "
    "select distinct f.doc_id, f.page_no, line_no, span_no from f where exists (select 1 from n where n.doc_id = f.doc_id and n.page_no = f.page_no and abs(ns - size) < 0.4 and abs(ny - oy) < 0.12 * ns)"
)
def false_superscripts(spark, sf_dir):
    return ops.false_superscripts(_spans(spark, sf_dir)).select("doc_id", "page_no", "line_no", "span_no")


@query("with l as (select doc_id, page_no, line_no, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from {spans} group by all) select * from l")
def union_rect(spark, sf_dir):
    return ops.union_rect(_spans(spark, sf_dir), "doc_id", "page_no", "line_no")


@query(
    "with w as (select *, max(x1) over (partition by doc_id, page_no, line_no order by x0, x1 rows between unbounded preceding and 1 preceding) as b from {spans}), "
    "c as (select *, sum(case when b is null or x0 - b >= 4 then 1 else 0 end) over (partition by doc_id, page_no, line_no order by x0, x1) as chain from w) select doc_id, page_no, line_no, chain, count(*) as n, min(x0) as x0, max(x1) as x1 from c group by all"
)
def chains(spark, sf_dir):
    found = ops.chains(_spans(spark, sf_dir), ["doc_id", "page_no", "line_no"], 4.0)
    return found.groupBy("doc_id", "page_no", "line_no", "chain").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query(
    "with recursive y as (select doc_id, page_no, list_sort(list(oy)) as ys from {spans} group by all), g as (select doc_id, page_no, ys, 1 as i, ys[1] as base, 1 as n from y union all "
    "select doc_id, page_no, ys, i + 1, case when ys[i + 1] - base > 9.0 then ys[i + 1] else base end, n + case when ys[i + 1] - base > 9.0 then 1 else 0 end from g where i < len(ys)) "
    "select doc_id, page_no, max(n) as n_rows from g group by all"
)
def row_bases(spark, sf_dir):
    return ops.row_bases(_spans(spark, sf_dir), ["doc_id", "page_no"], 10.0).select("doc_id", "page_no", F.size("bases").alias("n_rows"))


@query(
    "with recursive y as (select doc_id, page_no, list_sort(list(distinct oy)) as ys from {spans} group by all), g as (select doc_id, page_no, ys, ys[1] as base, 0 as row from y union all "
    "select doc_id, page_no, ys, list_filter(ys, lambda v: v - base > 9.0)[1], row + 1 from g where ys[len(ys)] - base > 9.0) "
    "select s.doc_id, s.page_no, line_no, span_no, arg_min(row, (abs(base - oy), row))::int as row from {spans} s join g using (doc_id, page_no) group by all"
)
def row_nearest(spark, sf_dir):
    """Each span's row: the nearest base of its page."""
    return ops.nearest_rows(_spans(spark, sf_dir), ["doc_id", "page_no"], 10.0).select("doc_id", "page_no", "line_no", "span_no", "row")


_SIDES = (
    f"{_BARS}, {_LINES}, s as (select b.doc_id, b.page_no, bar_no, line_no, math, l.x0, l.y0, l.x1, l.y1, (b.y0 + b.y1) / 2 - l.y1 as above, l.y0 - (b.y0 + b.y1) / 2 as below, 1.4 * greatest(6.0, l.y1 - l.y0) as far "
    "from bars b join lines l on b.doc_id = l.doc_id and b.page_no = l.page_no and least(l.x1, b.x1) - greatest(l.x0, b.x0) > 0 and least(l.x1, b.x1) - greatest(l.x0, b.x0) >= 0.6 * least(l.x1 - l.x0, b.x1 - b.x0) and l.x1 - l.x0 <= 1.3 * (b.x1 - b.x0)), "
    "p as (select *, case when above >= 0 and above < far then 'above' when below >= 0 and below < far then 'below' end as side, case when above >= 0 and above < far then above else below end as gap from s)"
)


@query(f"with {_SIDES} select doc_id, page_no, bar_no, line_no, side, gap from p where side is not null")
def fraction_sides(spark, sf_dir):
    sides = ops.bar_sides(ops.bars(_drawings(spark, sf_dir)), ops.lines(_spans(spark, sf_dir)))
    return sides.select("doc_id", "page_no", "bar_no", "line_no", "side", "gap")


@query(
    f"with {_SIDES}, r as (select doc_id, page_no, bar_no, min(case when side = 'above' then gap end) as up, min(case when side = 'below' then gap end) as down, bool_or(math) as math, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from p where side is not null group by all) "
    "select doc_id, page_no, bar_no, up, down, x0, y0, x1, y1 from r where up is not null and down is not null and math and abs(up - down) <= greatest(up, down, 1.0) * 0.65 + 1.5"
)
def fraction_join(spark, sf_dir):
    return ops.fraction_regions(ops.bars(_drawings(spark, sf_dir)), ops.lines(_spans(spark, sf_dir)))


_OPS = r"ops as (select doc_id, page_no, line_no as op_line, span_no as op_span, case trim(text) when '∑' then '\sum' else '\max' end as command, size as os, x0 as a, y0 as b, x1 as c, y1 as d from {spans} where (trim(text) = '∑' and font = 'CMMI10') or trim(text) = 'max')"


@query(
    f"with {_OPS}, p as (select s.doc_id, s.page_no, s.line_no, s.span_no, op_line, op_span, command, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy, a, b, c, d, c - a as wide, d - b as tall from {{spans}} s join ops o on s.doc_id = o.doc_id and s.page_no = o.page_no and size <= os - 0.4), "
    "q as (select *, case when cy > d - 0.2 * tall and cy < d + 1.6 * tall then 'below' when cy > b - 1.6 * tall and cy < b + 0.2 * tall then 'above' end as side from p), "
    "z as (select *, abs(cx - (a + c) / 2) + case when side = 'below' then greatest(0.0, cy - d) else greatest(0.0, b - cy) end as away from q where side is not null and cx between a - case when side = 'below' then wide else 0.3 * wide end and c + case when side = 'below' then wide else 0.3 * wide end) "
    "select doc_id, page_no, line_no, span_no, op_line, op_span, command, side from z qualify row_number() over (partition by doc_id, page_no, line_no, span_no order by away, op_line, op_span) = 1"
)
def nearest_limit(spark, sf_dir):
    return ops.nearest_limits(_spans(spark, sf_dir))


@query(
    r"with a as (select doc_id, page_no, line_no, span_no, (x0 + x1) / 2 as ax, (y0 + y1) / 2 as ay, y1 as ay1, greatest(1.0, 0.3 * size) as slack from {spans} where trim(text) = 'ˆ'), b as (select doc_id, page_no, line_no as base_line, span_no as base_span, trim(text) as base, size, x0, y0, x1, y1 from {spans} where trim(text) <> 'ˆ'), "
    "p as (select a.*, b.base_line, b.base_span, base, x0, x1, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy from a join b on a.doc_id = b.doc_id and a.page_no = b.page_no and ax between x0 - 1 and x1 + 1 and (y0 + y1) / 2 >= ay - slack and y1 >= ay1 - slack and y0 - ay1 < 0.5 * size) "
    r"select doc_id, page_no, line_no, span_no, base_line, base_span, greatest(0, least(length(base) - 1, floor((ax - x0) / ((x1 - x0) / length(base)))))::int as letter, '\hat' as command from p qualify row_number() over (partition by doc_id, page_no, line_no, span_no order by cy - ay, abs(cx - ax), base_line, base_span) = 1"
)
def accent_base(spark, sf_dir):
    return ops.accent_bases(_spans(spark, sf_dir))


_REGIONS = "select doc_id, page_no, x0, y0 - 20 as y0, x1 + 60 as x1, y0 + 25 as y1 from {drawings}"


@query(f"select doc_id, page_no, line_no, span_no from {{spans}} s where exists (select 1 from ({_REGIONS}) r where r.doc_id = s.doc_id and r.page_no = s.page_no and s.x0 >= r.x0 - 2 and s.x1 <= r.x1 + 2 and s.y0 >= r.y0 - 2 and s.y1 <= r.y1 + 2)")
def contains_semi(spark, sf_dir):
    return ops.contained(_spans(spark, sf_dir), corpus.rows(spark, sf_dir, _REGIONS)).select("doc_id", "page_no", "line_no", "span_no")


@query(f"select doc_id, page_no, line_no, span_no from {{spans}} s where not exists (select 1 from ({_REGIONS}) r where r.doc_id = s.doc_id and r.page_no = s.page_no and s.x0 < r.x1 and s.x1 > r.x0 and s.y0 < r.y1 and s.y1 > r.y0)")
def overlap_anti(spark, sf_dir):
    keys = ("doc_id", "page_no", "line_no", "span_no")
    return ops.untouched(_spans(spark, sf_dir), corpus.rows(spark, sf_dir, _REGIONS)).select(*keys)


_ROWS = (
    "with m as (select doc_id, page_no, round_even(oy, 1) as y, max(size) as size, string_agg(text, ' ' order by x0, text) as line from {spans} where font = 'CMTT9' group by all), "
    "s as (select *, case when lag(y) over w is null or y - lag(y) over w >= 3.2 * size then 1 else 0 end as s from m window w as (partition by doc_id, page_no order by y)), b as (select *, sum(s) over (partition by doc_id, page_no order by y) as block from s), "
    "r as (select doc_id, page_no, y, line, block, count(*) over (partition by doc_id, page_no, block) as n_rows from b qualify n_rows >= 3)"
)


@query(f"{_ROWS} select * from r")
def code_rows(spark, sf_dir):
    return ops.code_rows(_spans(spark, sf_dir)).select("doc_id", "page_no", "y", "line", "block", "n_rows")


@query(
    f"{_ROWS}, t as (select *, y - lag(y) over (partition by doc_id, page_no, block order by y) as step from r), l as (select *, min(step) over (partition by doc_id, page_no, block) as least from t) "
    "select doc_id, page_no, block, '```'||chr(10)||string_agg(repeat(chr(10), coalesce(round_even(step / least, 0)::int - 1, 0))||line, chr(10) order by y)||chr(10)||'```' as text from l group by all"
)
def code_blocks(spark, sf_dir):
    """Listings of pages, rebuilt with their blank rows."""
    from texmill.operators import listings

    return listings.fenced(ops.code_rows(_spans(spark, sf_dir)), "doc_id", "page_no")


@query("select doc_id, page_no, count(*) as n from (select *, x0 - lag(x1) over (partition by doc_id, page_no, line_no order by x0, span_no) > 0.2 * size as g from {spans}) x where g group by all")
def gap_spaces(spark, sf_dir):
    return ops.gap_spaces(_spans(spark, sf_dir)).filter("gap_before").groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n"))


@query(
    "with g as (select doc_id, unnest(string_split(lower(text), ' ')) as a from {documents} where doc_id % 2 = 0), h as (select doc_id - 1 as doc_id, unnest(string_split(lower(text), ' ')) as b from {documents} where doc_id % 2 = 1), "
    "ga as (select doc_id, a as glyph, count(*) as n from g group by all), hb as (select doc_id, b as glyph, count(*) as n from h group by all), s as (select doc_id, sum(least(ga.n, hb.n)) as shared from ga join hb using (doc_id, glyph) group by doc_id), "
    "na as (select doc_id, sum(n) as n from ga group by doc_id), nb as (select doc_id, sum(n) as n from hb group by doc_id) select na.doc_id, round(2.0 * coalesce(shared, 0) / (na.n + nb.n), 9) as agreement from na join nb using (doc_id) left join s using (doc_id)"
)
def dice_agreement(spark, sf_dir):
    words = corpus.rows(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("w"))
    a = words.filter("doc_id % 2 = 0").select("doc_id", F.col("w").alias("a"))
    b = words.filter("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("b"))
    return ops.bag_agreement(a.join(b, "doc_id"), "doc_id").select("doc_id", F.round("agreement", 9).alias("agreement"))


_CODE = "select o_orderkey % 300 as doc_id, o_orderkey as line_no, case when o_orderkey % 300 % 4 = 3 and o_custkey % 5 = 0 then '' else lpad(cast(row_number() over (partition by o_orderkey % 300 order by o_orderkey) as varchar(9)), 3, ' ')||' ' end||'x = '||cast(o_custkey as varchar(9)) as line from {orders}"


@query(
    rf"with c as ({_CODE}), n as (select *, regexp_matches(line, '^\s*(\d{{1,4}})(?:\s|$)') as has, try_cast(regexp_extract(line, '^\s*(\d{{1,4}})(?:\s|$)', 1) as int) as k, length(regexp_extract(line, '^\s*(\d{{1,4}})(?:\s|$)')) as cut from c), "
    "m as (select *, lag(k) over (partition by doc_id order by line_no) as b from n), d as (select doc_id, bool_and(has) and not bool_or(coalesce(b > k, false)) as ok, min(cut) as cut from m group by doc_id) "
    "select c.doc_id, line_no, case when ok then substr(line, d.cut + 1) else line end as line from c join d using (doc_id)"
)
def line_numbers(spark, sf_dir):
    from texmill.operators import listings

    return listings.without_line_numbers(corpus.rows(spark, sf_dir, _CODE))
