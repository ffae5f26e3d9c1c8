"""Markdown clean-up: headings, running heads, tables of contents, page selections, display formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from texmill.functions import markdown as md
from texmill.operators import lines as ops
from texmill.plans import corpus
from texmill.registry import query


def _of(name):
    return lambda spark, sf_dir: corpus.rows(spark, sf_dir, name)


_lines, _pages = _of("md_lines"), _of("md_pages")

_TITLE = r"regexp_replace(regexp_extract(line, '^(#{1,6})\s+(.*?)\s*$', 2), '^(?:\*\*|__)(.*?)(?:\*\*|__)$', '\1')"
_NUMBER = rf"regexp_extract({_TITLE}, '^(\d+(?:\.\d+)*)\.?\s+(\S.*)$', 1)"


@query(
    rf"select doc_id, line_no, case when not regexp_matches(line, '^(#{{1,6}})\s+(.*?)\s*$') then line when {_NUMBER} <> '' then repeat('#', cast(least(3, len(string_split({_NUMBER}, '.'))) as int))||' '||trim(regexp_extract({_TITLE}, '^(\d+(?:\.\d+)*)\.?\s+(\S.*)$', 2)) "
    rf"else regexp_extract(line, '^(#{{1,6}})', 1)||' '||{_TITLE} end as line from {{md_lines}}"
)
def heading_level(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", md.heading(F.col("line")).alias("line"))


_LOGOS = "select n_nationkey, n_name||' in L [A] TEX, LATEX and TEX, not TEXT or ' || chr(92) || 'TEX' as text from {nation}"


@query(
    rf"select n_nationkey, regexp_replace(regexp_replace(text, 'L\s*[\[{{]?A[\]}}]?\s*TEX|LATEX|LaTeX', '\\LaTeX{{}}', 'g'), '(^|[^A-Za-z\\])TEX($|[^A-Za-z])', '\1\\TeX{{}}\2', 'g') as text from ({_LOGOS}) x"
)
def fix_logo(spark, sf_dir):
    return corpus.rows(spark, sf_dir, _LOGOS).select("n_nationkey", md.logo(F.col("text")).alias("text"))


_CLEAN = (
    r"regexp_replace(regexp_replace(array_to_string(list_transform(list_transform(string_split(regexp_replace(regexp_replace(text, '(?m)^-{3,}\s*$', '', 'g'), '(?:\.[ \t]*){3,}', ' ', 'g'), chr(10)), "
    r"lambda x: regexp_replace(x, '\s+$', '')), lambda x: case when regexp_matches(x, '^\s*\d{1,4}\s*$') then '' else x end), chr(10)), '\n{4,}', chr(10)||chr(10)||chr(10), 'g'), '^\s+|\s+$', '', 'g')||chr(10)"
)


@query(f"select doc_id, page_no, {_CLEAN} as text from {{md_pages}}")
def clean_md(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", "page_no", md.clean(F.col("text")).alias("text"))


_HEADS = (
    "with u as (select doc_id, page_no, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as u from {md_pages}), "
    "e as (select doc_id, unnest(list_concat(u[1:2], u[-2:])) as line from u), c as (select doc_id, line, count(*) as n from e where length(line) between 3 and 120 group by all), "
    "s as (select doc_id, count(*) as pages from u group by doc_id), h as (select c.* from c join s using (doc_id) where pages >= 3 and n >= greatest(2, floor(pages * 0.6))) "
)


@query(_HEADS + "select * from h")
def running_heads(spark, sf_dir):
    return ops.running_heads(_pages(spark, sf_dir))


@query(
    _HEADS + ", r as (select doc_id, list(line) as heads from h group by doc_id) select p.doc_id, page_no, case when heads is null then text else array_to_string(list_filter(string_split(text, chr(10)), lambda x: not list_contains(heads, trim(x))), chr(10)) end as text from {md_pages} p left join r using (doc_id)"
)
def strip_running_heads(spark, sf_dir):
    return ops.without_running_heads(_pages(spark, sf_dir))


_TOC = r"(?i)^#{1,6}\s*(?:\*\*|__)?\s*(?:\d+[.\s]*)?(índice|indice|contenido|contents|table of contents|tabla de contenido)s?\s*(?:\*\*|__)?\s*$"


@query(
    "with l as (select *, starts_with(ltrim(line), '|') as t from {md_lines}), b as (select *, t and not coalesce(lag(t) over (partition by doc_id order by line_no), false) as s from l), "
    "i as (select *, max(case when s then line_no end) over (partition by doc_id order by line_no) as first_line from b), "
    r"g as (select doc_id, first_line, count(*) as n_rows, count_if(regexp_matches(line, '(?:\.[ \t]*){3,}')) as leaders from i where t group by all), "
    f"f as (select doc_id, line_no, coalesce(max(case when regexp_matches(line, '{_TOC}') then 1 else 0 end) over (partition by doc_id order by line_no rows between 3 preceding and 1 preceding), 0) = 1 as after_title from l where trim(line) <> '') "
    "select g.*, after_title, n_rows >= 3 and (leaders >= n_rows * 0.3 or after_title) as is_toc from g join f on g.doc_id = f.doc_id and g.first_line = f.line_no"
)
def toc_block(spark, sf_dir):
    return ops.toc_tables(_lines(spark, sf_dir))


@query(
    r"with l as (select *, lag(line) over w as p, lead(line) over w as n, regexp_extract(line, '^\s*\$(.+?)\$\s*$', 1) as body from {md_lines} window w as (partition by doc_id order by line_no)) "
    "select doc_id, line_no, '$$'||trim(body)||'$$' as display from l where length(body) >= 6 and trim(coalesce(p, '')) = '' and trim(coalesce(n, '')) = ''"
)
def promote_display(spark, sf_dir):
    return ops.display_candidates(_lines(spark, sf_dir))


_PAGES = "select o_custkey % 200 as doc_id, o_orderkey % 60 as page from {orders}"


@query(
    f"with p as (select distinct * from ({_PAGES}) x), r as (select *, page - row_number() over (partition by doc_id order by page) as run from p), e as (select doc_id, min(page) as a, max(page) as b from r group by doc_id, run) "
    "select doc_id, string_agg(case when a = b then cast(a + 1 as varchar) else (a + 1)||'-'||(b + 1) end, ',' order by a) as ranges from e group by doc_id"
)
def page_ranges(spark, sf_dir):
    return ops.page_ranges(corpus.rows(spark, sf_dir, _PAGES))


_SPECS = "select p_partkey, cast(p_size as varchar(9))||', '||cast(p_size % 7 + 9 as varchar(9))||'-'||cast(p_size % 5 + 1 as varchar(9))||',,'||cast(p_size % 4 + 2 as varchar(9)) as spec from {part}"


@query(
    f"with s as ({_SPECS}), t as (select p_partkey, spec, unnest(list_filter(list_transform(string_split(spec, ','), lambda x: trim(x)), lambda x: x <> '')) as part from s), "
    "e as (select p_partkey, spec, unnest(generate_series(least(split_part(part, '-', 1)::int, coalesce(nullif(split_part(part, '-', 2), '')::int, split_part(part, '-', 1)::int)), greatest(split_part(part, '-', 1)::int, coalesce(nullif(split_part(part, '-', 2), '')::int, split_part(part, '-', 1)::int)))) - 1 as page from t) "
    "select p_partkey, spec, string_agg(distinct page::varchar, ',' order by page::varchar) as unused, array_to_string(list_sort(list_distinct(list(page))), ',') as pages from e where page >= 0 group by all".replace("string_agg(distinct page::varchar, ',' order by page::varchar) as unused, ", "")
)
def parse_pages(spark, sf_dir):
    return corpus.rows(spark, sf_dir, _SPECS).select("p_partkey", "spec", F.array_join(md.pages(F.col("spec")).cast("array<string>"), ",").alias("pages"))


_PICTURES = "select n_nationkey, 'Before **----- Start of picture text -----**<br>'||chr(10)||n_name||chr(10)||'**----- End of picture text -----**<br>'||' after' as text from {nation}"


@query(rf"select n_nationkey, regexp_replace(text, '(?s)\*{{0,2}}-{{3,}}\s*Start of picture text\s*-{{3,}}\*{{0,2}}.*?\*{{0,2}}-{{3,}}\s*End of picture text\s*-{{3,}}\*{{0,2}}(?:<br>)?', '', 'g') as text from ({_PICTURES}) x")
def strip_picture_text(spark, sf_dir):
    return corpus.rows(spark, sf_dir, _PICTURES).select("n_nationkey", md.without_picture_text(F.col("text")).alias("text"))


_IMAGES = "select n_nationkey, '![a](img'||chr(92)||n_name||chr(92)||'x.png) and ![web](https://host/'||n_name||'.png), ![b]( /work/out/'||n_name||'.png ) ![c](/work/doc/c.png)' as text from {nation}"


@query("select n_nationkey, '![a](img/'||n_name||'/x.png) and ![web](https://host/'||n_name||'.png), ![b](../out/'||n_name||'.png) ![c](c.png)' as text from {nation}")
def relocate_images(spark, sf_dir):
    return corpus.rows(spark, sf_dir, _IMAGES).select("n_nationkey", md.images(F.col("text"), F.lit("/work/doc/")).alias("text"))


_WORDS = "select c_custkey % 40 as doc_id, c_custkey as line_no, c_mktsegment||' '||c_name as text from {customer}"


@query(
    f"with l as (select doc_id, line_no, string_split(text, ' ') as w, lead(string_split(text, ' ')) over v as w2, lead(string_split(text, ' '), 2) over v as w3 from ({_WORDS}) x window v as (partition by doc_id order by line_no)), "
    f"c as (select doc_id, line_no, 1 as n, w as words from l union all select doc_id, line_no, 2, list_concat(w, w2) from l where w2 is not null union all select doc_id, line_no, 3, list_concat(list_concat(w, w2), w3) from l where w3 is not null), "
    f"h as (select doc_id, line_no as heading_no, list_reverse(string_split(text, ' ')) as t from ({_WORDS}) x) "
    "select doc_id, heading_no, array_to_string(arg_min(words, (n, line_no)), ' ') as title from h join c using (doc_id) where list_sort(t) = list_sort(words) and t <> words group by doc_id, heading_no"
)
def bag_equal_reorder(spark, sf_dir):
    """A heading of each line, its words in another order, against runs of one to three lines."""
    rows = corpus.rows(spark, sf_dir, _WORDS).withColumn("tokens", F.split("text", " "))
    headings = rows.select("doc_id", F.col("line_no").alias("heading_no"), F.reverse("tokens").alias("tokens"))
    return ops.same_words(headings, rows.drop("text")).select("doc_id", "heading_no", F.array_join("words", " ").alias("title"))
