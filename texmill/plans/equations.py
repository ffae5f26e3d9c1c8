"""Equations from their pieces, replacements by offset and by pattern, images, positions, line states."""

from __future__ import annotations

from pyspark.sql import functions as F

from texmill.operators import equations as ops
from texmill.operators import layout as geometry
from texmill.plans import corpus
from texmill.plans.corpus import tex
from texmill.registry import query

_RAW = "select c_custkey, c_name||' L[A] '||c_mktsegment||' [x y]' as text from {customer}"


@query(rf"select c_custkey, array_to_string(regexp_extract_all(text, '\[[^\]\s]*\]|[^\s\[]+'), '|') as tokens from ({_RAW}) x")
def raw_line_tokens(spark, sf_dir):
    return corpus.rows(spark, sf_dir, _RAW).select("c_custkey", F.array_join(F.regexp_extract_all("text", F.lit(r"\[[^\]\s]*\]|[^\s\[]+"), F.lit(0)), "|").alias("tokens"))


_FRAGMENTS = f"select n_nationkey, n_name as a, {tex('~infty')} as b, {tex('~sum_{i} x')} as c, 'y = 2' as d from {{nation}}"


@query(f"select n_nationkey, n_name||' '||{tex('~sum^{~infty}_{i} x')}||' y = 2' as latex from {{nation}}")
def merge_fragments(spark, sf_dir):
    return corpus.rows(spark, sf_dir, _FRAGMENTS).select("n_nationkey", ops.merged_fragments(F.array("a", "b", "c", "d")).alias("latex"))


_EQUATIONS = (
    f"select p_partkey % 100 as doc_id, 0 as page_no, cast(p_partkey * 13 % 997 as double) as y, case p_size % 5 when 0 then {tex('~sum_{i}')} when 1 then '_{{k}} z' when 2 then 'a = b' else 'c'||cast(p_size as varchar(3)) end as latex from {{part}}"
)


@query(
    f"with recursive e as (select doc_id, page_no, list_sort(list(struct_pack(y, latex))) as e from ({_EQUATIONS}) x group by all), "
    "g as (select doc_id, page_no, e, 1 as i, e[1].y as y, e[1].latex as latex, e[1].latex as tail, 1 as n, 1 as k from e union all "
    rf"select doc_id, page_no, e, i + 1, case when p then y else e[i + 1].y end, case when p then latex||e[i + 1].latex else e[i + 1].latex end, e[i + 1].latex, case when p then n + 1 else 1 end, case when p then k else k + 1 end "
    rf"from (select *, (regexp_matches(e[i + 1].latex, '^[_^]\{{') or regexp_matches(latex, '{ops.OPEN_END}')) and e[i + 1].y - y < 60 as p from g where i < len(e)) h) "
    "select doc_id, page_no, y, latex, n from g qualify row_number() over (partition by doc_id, page_no, k order by i desc) = 1"
)
def join_splits(spark, sf_dir):
    return ops.joined_splits(corpus.rows(spark, sf_dir, _EQUATIONS))


_N = r"length(regexp_replace(text, '[()\[\]{}0-9+\-=.,;:!/|<> \t]', '', 'g'))"


@query(
    f"with l as (select doc_id, page_no, line_no, min(x0) as x0, max(x1) as x1, min(oy) as y, sum({_N}) as d, sum(case when font = 'CMMI10' then {_N} else 0 end) as m from {{spans}} where trim(text) <> '' group by all) "
    "select doc_id, page_no, line_no, y, round(m / d::double, 9) as share from l where abs((x0 + x1) / 2 - 80.0) / 160.0 < 0.15 and d >= 1 and m / d::double >= 0.45"
)
def display_lines(spark, sf_dir):
    spans = corpus.rows(spark, sf_dir, "spans")
    widths = spans.select("doc_id", "page_no").distinct().withColumn("width", F.lit(160.0))
    return ops.display_lines(spans, widths).withColumn("share", F.round("share", 9))


_ATOMS = f"select p_partkey, {tex('~frac{x}{~sin y} ~leq ')}||cast(p_size as varchar(3)) as latex from {{part}}"


@query(rf"select p_partkey, 'x|s|i|n|y|\leq|'||array_to_string(string_split(p_size::varchar, ''), '|') as atoms from {{part}}")
def formula_atoms(spark, sf_dir):
    return corpus.rows(spark, sf_dir, _ATOMS).select("p_partkey", F.array_join(ops.atoms(F.col("latex")), "|").alias("atoms"))


@query("select doc_id, '<'||substr(text, 1, 2)||'>'||substr(text, 3, 4)||'#'||substr(text, 9) as text from {documents} where length(text) > 20")
def replace_boxes(spark, sf_dir):
    docs = corpus.rows(spark, sf_dir, "documents").filter(F.length("text") > 20)
    part = lambda a, b, new: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), new.alias("new"))
    first = F.concat(F.lit("<"), F.substr("text", F.lit(1), F.lit(2)), F.lit(">"))
    return docs.select("doc_id", ops.replaced_at(F.col("text"), F.array(part(0, 2, first), part(6, 8, F.lit("#")))).alias("text"))


_MARKED = "select n_nationkey, 'see _E_ = [m]c[2] and '||n_name as text from {nation}"


@query("select n_nationkey, 'see $E=mc^{2}$ and '||n_name as text from {nation}")
def apply_fixes(spark, sf_dir):
    fixes = F.array(F.struct(F.lit("E=mc2").alias("plain"), F.lit("$E=mc^{2}$").alias("latex")), F.struct(F.lit("mc2").alias("plain"), F.lit("$wrong$").alias("latex")))
    return corpus.rows(spark, sf_dir, _MARKED).select("n_nationkey", F.regexp_replace(ops.applied(F.col("text"), fixes), r"\$\]", "\\$").alias("text"))


_IMAGES = "select n_regionkey as doc_id, n_nationkey as pos, 'img'||cast(n_nationkey as varchar(9)) as a from {nation} where n_nationkey <> 7"
_LATEX = "select n_regionkey as doc_id, n_nationkey as pos, n_name as b from {nation}"


@query(
    f"with i as (select doc_id, a, row_number() over (partition by doc_id order by pos) as k, count(*) over (partition by doc_id) as n from ({_IMAGES}) x), l as (select doc_id, b, row_number() over (partition by doc_id order by pos) as k, count(*) over (partition by doc_id) as n from ({_LATEX}) y) "
    "select doc_id, k, a, b from i join l using (doc_id, k, n)"
)
def positional_zip(spark, sf_dir):
    return ops.zipped(corpus.rows(spark, sf_dir, _IMAGES), corpus.rows(spark, sf_dir, _LATEX), "doc_id")


_SYNC = (
    "select s_suppkey as query_id, 1 as line_no, 'Output:x.pdf' as line from {supplier} union all select s_suppkey, 2, 'Page:'||cast(s_suppkey % 9 + 1 as varchar(9)) from {supplier} union all select s_suppkey, 3, 'h:10.5' from {supplier} "
    "union all select s_suppkey, 4, 'v:'||cast(s_suppkey as varchar(9)) from {supplier} union all select s_suppkey, 5, 'W:300' from {supplier} union all select s_suppkey, 6, 'H:'||cast(s_suppkey % 20 as varchar(9)) from {supplier} where s_suppkey % 7 <> 0"
)


@query("select s_suppkey as query_id, (s_suppkey % 9 + 1)::int as page, 10.5::double as x, greatest(0.0, s_suppkey - s_suppkey % 20)::double as y, 300.0::double as width, (case when s_suppkey % 20 = 0 then 12.0 else s_suppkey % 20 end)::double as height from {supplier} where s_suppkey % 7 <> 0")
def sync_points(spark, sf_dir):
    return ops.sync_points(corpus.rows(spark, sf_dir, _SYNC))


_STATES = f"select o_custkey % 90 as doc_id, o_orderkey as line_no, case o_orderkey % 11 when 0 then {tex('~begin{verbatim}')} when 2 then {tex('~end{verbatim}')} when 4 then {tex('~begin{align*}')} when 7 then {tex('~end{align*}')} else 'text' end as line from {{orders}}"


@query(
    f"with m as (select *, case o when 2 then 'normal' when 7 then 'normal' when 0 then 'verbatim' when 4 then 'math' end as mark from (select *, line_no % 11 as o from ({_STATES}) x) y) "
    "select doc_id, line_no, line, coalesce(last_value(mark ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 'normal') as state from m"
)
def line_states(spark, sf_dir):
    return ops.line_states(corpus.rows(spark, sf_dir, _STATES))


_KEPT = "select n_regionkey as doc_id, '![a](img'||cast(n_nationkey as varchar(9))||'.png) text' as text from {nation} where n_nationkey % 2 = 0"
_ALL = "select n_regionkey as doc_id, 'img'||cast(n_nationkey as varchar(9))||'.png' as path from {nation}"


@query("select n_regionkey as doc_id, 'img'||n_nationkey||'.png' as path from {nation} where n_nationkey % 2 = 1")
def unused_images(spark, sf_dir):
    return ops.unused(corpus.rows(spark, sf_dir, _ALL), corpus.rows(spark, sf_dir, _KEPT))


_CHARS = "select doc_id, page_no, line_no, span_no, i, case when i = 0 and span_no % 2 = 0 then ' ' else substr('abc', cast(i + 1 as int), 1) end as c, oy - i as oy, y0 - 2.0 * i as y0 from {spans} cross join (select 0 as i union all select 1 as i union all select 2 as i) n"


@query("select doc_id, page_no, line_no, span_no, case when span_no % 2 = 0 then ' bc' else 'abc' end as text, oy - case when span_no % 2 = 0 then 1 else 0 end as oy, y0 - 4.0 as y0 from {spans}")
def reanchor_spans(spark, sf_dir):
    return ops.anchored(corpus.rows(spark, sf_dir, _CHARS))


@query()
def script_fixes(spark, sf_dir):
    """Words with the scripts that hang on them, as replacements; spans of all fonts count, blank ones do not."""
    return ops.script_fixes(geometry.scripts(corpus.rows(spark, sf_dir, "spans").filter(F.trim("text") != "")))
