"""Regions of pages: clusters and fractions, rows, intruders, numbers, runs, extension glyphs, grids of listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from texmill.functions import formulas, layout as f, readings
from texmill.operators import layout as geometry, regions as ops
from texmill.plans import corpus
from texmill.plans.corpus import tex
from texmill.plans.layout import _BASE, _LINES, _SIDES
from texmill.registry import query
from texmill.storage import stash

_PAGE = "doc_id, page_no"


def _spans(spark, sf_dir):
    return corpus.rows(spark, sf_dir, "spans")


def _boxes(spark, sf_dir):
    return geometry.lines(_spans(spark, sf_dir))


def _fractions(spark, sf_dir):
    return geometry.fraction_regions(geometry.bars(corpus.rows(spark, sf_dir, "drawings")), _boxes(spark, sf_dir))


def _fold(name: str, rows: str, order: str, keep: str, same: str) -> str:
    """Recursive SQL: rows of a page in order, each joining the group before it, whose box is u, if same holds."""
    box = ", ".join(f"case when {same} then {'least' if c[1] == '0' else 'greatest'}(u{c}, o.{c}) else o.{c} end" for c in ("x0", "y0", "x1", "y1"))
    kept = ", ".join(f"o.{c}" for c in keep.split(", "))
    return (
        f"{name}_o as (select *, row_number() over (partition by {_PAGE} order by {order}) as i from {rows}), {name} as (select {_PAGE}, i, {keep}, x0, y0, x1, y1, 1 as k, x0 as ux0, y0 as uy0, x1 as ux1, y1 as uy1 from {name}_o where i = 1 "
        f"union all select o.doc_id, o.page_no, o.i, {kept}, o.x0, o.y0, o.x1, o.y1, case when {same} then k else k + 1 end, {box} from {name} g join {name}_o o on g.doc_id = o.doc_id and g.page_no = o.page_no and o.i = g.i + 1)"
    )


_NEAR = "o.y0 - uy1 < 14 and least(ux1, o.x1) - greatest(ux0, o.x0) > -18"
_CLUSTERS = _fold("c", "lines", "y0, x0, line_no", "line_no, text", _NEAR)
_REGION = (
    "reg as (select doc_id, page_no, bar_no, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, min(case when side = 'above' then gap end) as up, min(case when side = 'below' then gap end) as down from p where side is not null group by all "
    "having up is not null and down is not null and bool_or(math) and abs(up - down) <= greatest(up, down, 1.0) * 0.65 + 1.5)"
)
_OVERLAP = "a.x0 < b.x1 and a.x1 > b.x0 and a.y0 < b.y1 and a.y1 > b.y0"


@query(f"with recursive {_LINES}, {_CLUSTERS} select doc_id, page_no, k as cluster, count(*) as n_lines, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from c group by all")
def cluster_merge(spark, sf_dir):
    """Lines close below each other and side by side, as clusters."""
    found = ops.clusters(_boxes(spark, sf_dir)).groupBy("doc_id", "page_no", "cluster")
    return found.agg(F.count(F.lit(1)).alias("n_lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query(
    f"with recursive {_SIDES}, {_REGION}, {_CLUSTERS}, a as (select doc_id, page_no, k as cluster, count(*) as n_lines, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from c group by all), "
    f"m as (select a.doc_id, a.page_no, cluster, min(b.x0) as x0, min(b.y0) as y0, max(b.x1) as x1, max(b.y1) as y1 from a join reg b on a.doc_id = b.doc_id and a.page_no = b.page_no and {_OVERLAP} group by all), "
    "w as (select a.doc_id, a.page_no, a.cluster, n_lines, m.x0 is not null as has, case when m.x0 is null then a.x0 else least(a.x0, m.x0) - 4 end as x0, case when m.x0 is null then a.y0 else least(a.y0, m.y0) - 3 end as y0, "
    "case when m.x0 is null then a.x1 else greatest(a.x1, m.x1) + 4 end as x1, case when m.x0 is null then a.y1 else greatest(a.y1, m.y1) + 3 end as y1 from a left join m on a.doc_id = m.doc_id and a.page_no = m.page_no and a.cluster = m.cluster), "
    + _fold("h", "w", "cluster", "n_lines, has", "ux0 < o.x1 and ux1 > o.x0 and uy0 < o.y1 and uy1 > o.y0")
    + " select doc_id, page_no, k as cluster, sum(n_lines)::bigint as n_lines, bool_or(has) as has_fraction, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from h group by all"
)
def cluster_regions(spark, sf_dir):
    """Clusters grown around the fractions that they touch, and merged where they then overlap."""
    return ops.grown_clusters(ops.clusters(_boxes(spark, sf_dir)), _fractions(spark, sf_dir)).select("doc_id", "page_no", "cluster", "n_lines", "has_fraction", "x0", "y0", "x1", "y1")


@query(
    f"with recursive {_LINES}, {_CLUSTERS}, o as (select doc_id, page_no, k, y0, x0, text, row_number() over (partition by doc_id, page_no, k order by y0, x0, text) as j from c), "
    "r as (select doc_id, page_no, k, j, y0, x0, text, 1 as row, y0 as first from o where j = 1 union all select o.doc_id, o.page_no, o.k, o.j, o.y0, o.x0, o.text, case when abs(o.y0 - first) < 6 then row else row + 1 end, case when abs(o.y0 - first) < 6 then first else o.y0 end "
    "from r join o on r.doc_id = o.doc_id and r.page_no = o.page_no and r.k = o.k and o.j = r.j + 1), t as (select doc_id, page_no, k, row, string_agg(text, ' ' order by x0, text) as line from r group by all) "
    f"select doc_id, page_no, k as cluster, case when count(*) = 1 then min(line) else {tex('~begin{aligned} ')}||string_agg(line, {tex(' ~~ ')} order by row)||{tex(' ~end{aligned}')} end as latex from t group by all"
)
def collapse_rows(spark, sf_dir):
    """One formula for each cluster, its rows aligned."""
    return ops.collapsed(ops.clusters(_boxes(spark, sf_dir), "text").withColumnRenamed("text", "latex"))


@query(
    f"with {_SIDES}, {_REGION} select b.doc_id, b.page_no, bar_no, a.line_no from reg b join lines a on a.doc_id = b.doc_id and a.page_no = b.page_no and {_OVERLAP} "
    "where not exists (select 1 from p where p.side is not null and p.doc_id = b.doc_id and p.page_no = b.page_no and p.bar_no = b.bar_no and p.line_no = a.line_no)"
)
def intruder_lines(spark, sf_dir):
    """Lines that lie over a fraction's region without being its numerator or denominator."""
    boxes = stash(_boxes(spark, sf_dir).drop("text"))
    bars = geometry.bars(corpus.rows(spark, sf_dir, "drawings"))
    return ops.intruders(geometry.fraction_regions(bars, boxes, with_bars=True), boxes)


@query(
    f"with {_SIDES}, {_REGION} select b.doc_id, b.page_no, bar_no, coalesce(string_agg(trim(a.text), '' order by a.line_no), '') as text from reg b left join lines a on a.doc_id = b.doc_id and a.page_no = b.page_no "
    "and a.x0 >= b.x0 - 2 and a.x1 <= b.x1 + 2 and a.y0 >= b.y0 - 2 and a.y1 <= b.y1 + 2 group by all"
)
def region_text(spark, sf_dir):
    boxes = stash(_boxes(spark, sf_dir))
    return ops.region_texts(geometry.fraction_regions(geometry.bars(corpus.rows(spark, sf_dir, "drawings")), boxes), boxes)


_NUMBERED = "select doc_id, page_no, line_no, span_no, case when span_no % 3 = 0 then '('||cast(span_no as varchar(9))||case when line_no % 2 = 0 then 'a' else '' end||')' else text end as text, x0, x1 from {spans}"


@query(f"select doc_id, page_no, line_no, span_no, text from (select *, max(case when span_no % 3 <> 0 then x1 end) over (partition by doc_id, page_no, line_no) as r from ({_NUMBERED}) x) y where not (span_no % 3 = 0 and x0 > coalesce(r, 0) + 5)")
def equation_numbers(spark, sf_dir):
    """Spans of lines without the equation numbers at their right."""
    return ops.without_numbers(corpus.rows(spark, sf_dir, _NUMBERED), ["doc_id", "page_no", "line_no"]).select("doc_id", "page_no", "line_no", "span_no", "text")


_ROOTS = "select doc_id, case line_no % 5 when 0 then '√' when 1 then 'p' when 2 then ' s ' else text end as text, case when span_no % 2 = 0 then 'CMEX10' else font end as font from {spans}"


@query(f"select doc_id, trim(text) as mark, font, count(*) as n from ({_ROOTS}) x where trim(text) = '√' or (trim(text) in ('p', 's') and font = 'CMEX10') group by all")
def radical_marks(spark, sf_dir):
    rows = corpus.rows(spark, sf_dir, _ROOTS).filter(f.radical(F.col("text"), F.col("font")))
    return rows.groupBy("doc_id", F.trim("text").alias("mark"), "font").agg(F.count(F.lit(1)).alias("n"))


@query(
    "with fs as (select distinct f.doc_id, f.page_no, f.line_no, f.span_no from {spans} f where flags % 2 = 1 and exists (select 1 from {spans} n where n.flags % 2 = 0 and trim(n.text) <> '' and n.doc_id = f.doc_id and n.page_no = f.page_no and abs(n.size - f.size) < 0.4 and abs(n.oy - f.oy) < 0.12 * n.size)), "
    "m as (select s.doc_id, s.page_no, s.line_no, s.span_no, text, fs.span_no is not null as bad from {spans} s left join fs on s.doc_id = fs.doc_id and s.page_no = fs.page_no and s.line_no = fs.line_no and s.span_no = fs.span_no where trim(text) <> ''), "
    "k as (select *, sum(case when bad then 0 else 1 end) over (partition by doc_id, page_no, line_no order by span_no) as run from m) "
    "select doc_id, page_no, line_no, min(span_no) as first, count(*)::int as n, string_agg(trim(text), '|' order by span_no) as text from k where bad group by doc_id, page_no, line_no, run having count(*) >= 2 or max(length(trim(text))) >= 3"
)
def false_superscript_runs(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return ops.false_runs(spans, geometry.false_superscripts(spans))


_TALL = "select doc_id, page_no, line_no, span_no, text, case when span_no % 5 = 4 then 'CMEX10' else font end as font, cast(size as double) as size, oy - case when span_no % 5 = 4 then 9 else 0 end as oy, x0, y0, x1, y1 from {spans}"
_PLAIN_BASE = _BASE.replace("{spans} where", f"({_TALL}) q where font <> 'CMEX10' and")


@query(
    f"with s as ({_TALL}), {_PLAIN_BASE}, n as (select * from s where font <> 'CMEX10'), e as (select s.*, base_size, exists (select 1 from n where n.doc_id = s.doc_id and n.page_no = s.page_no and n.line_no = s.line_no and abs(n.size - s.size) < 0.6) as own from s join base using (doc_id, page_no, line_no) where s.font = 'CMEX10'), "
    "z as (select *, case when own then size else base_size end as ns, least(oy, y0) as top from e), "
    "v as (select z.*, (select min(n.oy) from n where n.doc_id = z.doc_id and n.page_no = z.page_no and n.line_no = z.line_no and abs(n.size - z.ns) < 0.6 and n.oy > z.top) as below, (select max(n.oy) from n where n.doc_id = z.doc_id and n.page_no = z.page_no and n.line_no = z.line_no and abs(n.size - z.ns) < 0.6) as last from z) "
    "select doc_id, page_no, line_no, span_no, ns as size, coalesce(below, last, oy) as oy, top as y0, greatest(y1, 2 * (coalesce(below, last, oy) - 0.25 * ns) - top) as y1 from v"
)
def extension_glyphs(spark, sf_dir):
    """Glyphs of extension fonts with the size, baseline and height that their lines give them, where these have others."""
    spans = corpus.rows(spark, sf_dir, _TALL)
    ext = f.extension_font(F.col("font"))
    lines = geometry.baselines(spans.filter(~ext))
    fixed = ops.extension_fixed(spans, lines).filter(ext)
    return fixed.join(lines.select("doc_id", "page_no", "line_no"), ["doc_id", "page_no", "line_no"], "left_semi").select("doc_id", "page_no", "line_no", "span_no", "size", "oy", "y0", "y1")


_LETTERS = "select doc_id, page_no, line_no, span_no as chunk, i, case when i = 0 and span_no % 2 = 0 then ' ' else substr('abc', cast(i + 1 as int), 1) end as c, x0 + (2.5 + span_no % 3) * i as x0, x0 + (2.5 + span_no % 3) * i + 2 as x1, oy as y from {spans} cross join (select 0 as i union all select 1 as i union all select 2 as i) n"


@query(
    f"with l as ({_LETTERS}), g as (select *, (x0 + x1) / 2 as m, (x0 + x1) / 2 - lag((x0 + x1) / 2) over (partition by doc_id, page_no, line_no, chunk order by i) as gap from l), "
    "t as (select doc_id, page_no, list_sort(list(gap) filter (gap > 0)) as p, min(m) filter (trim(c) <> '') as first from g group by all), r as (select doc_id, page_no, line_no, min(y) as y from l group by all), "
    "s as (select doc_id, page_no, coalesce(min(d), 1.0) as step from (select *, y - lag(y) over (partition by doc_id, page_no order by y) as d from r) x group by all) select doc_id, page_no, round(p[len(p) // 2 + 1], 9) as pitch, first, step from t join s using (doc_id, page_no)"
)
def code_grid(spark, sf_dir):
    """Pitch, margin and row step of the monospaced grid of each page."""
    found = ops.grid(corpus.rows(spark, sf_dir, _LETTERS), ["doc_id", "page_no"], "line_no")
    return found.withColumn("pitch", F.round("pitch", 9))


@query()
def code_lines(spark, sf_dir):
    """Lines of listings, each chunk at its column of the page's grid; the tests compare with a plain loop."""
    chars = corpus.rows(spark, sf_dir, _LETTERS)
    return ops.code_lines(chars, ops.grid(chars, ["doc_id", "page_no"], "line_no"), ["doc_id", "page_no"], "line_no")


_BOUNDED = f"select n_nationkey, {tex('See ~pandocbounded{~includegraphics{')}||n_name||{tex('}} and ~pandocbounded{x}.')} as text from {{nation}}"


@query(f"select n_nationkey, {tex('See {~includegraphics{')}||n_name||'}}}} and {{x}}.' as text from {{nation}}")
def word_friendly(spark, sf_dir):
    """Sources without the macro that loses their images."""
    return corpus.rows(spark, sf_dir, _BOUNDED).select("n_nationkey", F.replace("text", F.lit("\\pandocbounded{"), F.lit("{")).alias("text"))


@query("select c_custkey, c_name||' é '||c_mktsegment as text from {customer}")
def byte_letters(spark, sf_dir):
    """Model tokens in byte letters as text."""
    rows = corpus.rows(spark, sf_dir, "select c_custkey, replace(c_name||' é '||c_mktsegment, ' ', 'Ġ') as text from {customer}")
    return rows.select("c_custkey", readings.byte_decoded(F.replace("text", F.lit("é"), F.lit("Ã©"))).alias("text"))


_STATED = "select p_partkey, 'Let **E = m_'||cast(p_size as varchar(9))||' v** be.' as text, case p_partkey % 4 when 0 then 'E' when 1 then 'absent words' else 'E=m'||cast(p_size as varchar(9))||'v' end as plain, 'E = m_{'||cast(p_size as varchar(9))||'} $v' as latex from {part}"


@query(f"select p_partkey, case when p_partkey % 4 > 1 then 'Let '||{tex('^^^^$$^^E = m_{')}||cast(p_size as varchar(9))||{tex('} $v^^$$^^^^ be.')} end as text from {{part}}")
def formulas_in_text(spark, sf_dir):
    """A formula's plain text, found among marks of Markdown, as a display; null where it must be placed otherwise."""
    rows = corpus.rows(spark, sf_dir, _STATED)
    return rows.select("p_partkey", ops.replaced_by_formulas(F.col("text"), formulas.tolerant(F.col("plain")), F.col("latex")).alias("text"))


@query("select region_id // 10 as cluster, min(c) as confidence from (select region_id, avg(dpi / 400.0) as c from {readings} group by region_id) x group by 1")
def reading_confidence(spark, sf_dir):
    rows = corpus.rows(spark, sf_dir, "readings").select(F.floor(F.col("region_id") / 10).alias("cluster"), "region_id", (F.col("dpi") / 400.0).alias("confidence"))
    return ops.confidences(rows, "region_id", "cluster")
