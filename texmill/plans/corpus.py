"""Inputs that the tables do not hold as they are: formulas, pages, logs and glyph geometry, derived from their columns.

Each is one SQL text that Spark and DuckDB both run, so a query and the SQL that checks it see the same rows. In the texts
{name} stands for a table or for another derived input, and ~ in a literal marked by tex() for a backslash.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from texmill.storage import reachable

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def tex(text: str) -> str:
    """SQL for a literal with backslashes (written ~) and line ends (written ^^); both dialects read it alike."""
    out = "'" + text.replace("'", "''").replace("~", "'||chr(92)||'").replace("^^", "'||chr(10)||'") + "'"
    return "(" + out + ")"


_V1 = "substr('abcdefgh', cast(p_size % 8 as int) + 1, 1)"
_V2 = "substr('uvwxyz', cast(p_partkey % 6 as int) + 1, 1)"
_N = "cast(p_size % 10 as varchar(3))"


def _formula(v1: str) -> str:
    cases = [
        f"{tex('~sum_{')}||{v1}||'=1}}^{{'||{_N}||'}} '||{_V2}||'_{{'||{v1}||'}}'",
        f"{tex('~frac{')}||{v1}||'}}{{'||{_V2}||{tex('} ~le ')}||{_N}",
        f"{tex('~sqrt{')}||{v1}||' + '||{_V2}||'}} = '||{_N}",
        f"{v1}||'^{{2}} + '||{_V2}||'^{{2}} = '||{_N}||'.'",
        f"{tex('~left( ')}||{v1}||{tex(' ~right) ~to ')}||{_V2}",
        f"{tex('~begin{pmatrix} ')}||{v1}||' & '||{_V2}||{tex(' ~end{pmatrix}')}",
        f"{v1}||' '||{tex('~ldots')}||' '||{v1}",
    ]
    return "case " + " ".join(f"when p_size % 7 = {k} then {c}" for k, c in enumerate(cases)) + " end"


DERIVED = {
    # formulas of 20 documents, and what a conversion of them found: every eleventh is lost, every fourth damaged
    "originals": f"select p_partkey % 20 as doc_id, row_number() over (partition by p_partkey % 20 order by p_partkey) - 1 as seq, {_formula(_V1)} as text, p_size % 3 = 0 as display from {{part}}",
    "found": f"select p_partkey % 20 as doc_id, row_number() over (partition by p_partkey % 20 order by p_partkey) - 1 as seq, {_formula("case when p_partkey % 4 = 0 then 'q' else " + _V1 + ' end')} as text from {{part}} where p_partkey % 11 <> 0",
    # pages of Markdown: a running head, a body, a page number
    "md_pages": "select o_orderkey % 40 as doc_id, row_number() over (partition by o_orderkey % 40 order by o_orderkey) as page_no, "
    "'Annual report '||cast(o_orderkey % 40 as varchar(9))||chr(10)||o_orderpriority||chr(10)||'Body of '||cast(o_orderkey as varchar(19))||' by '||cast(o_custkey as varchar(19))||'  '||chr(10)||"
    "case when o_orderkey % 3 = 0 then '-----'||chr(10) else '' end||'See chapter . . . . 12'||chr(10)||o_orderstatus||chr(10)||cast(o_orderkey % 900 as varchar(9)) as text from {orders}",
    # Markdown lines with headings, tables and formulas
    "md_lines": "select o_custkey % 60 as doc_id, row_number() over (partition by o_custkey % 60 order by o_orderkey) as line_no, "
    "case o_orderkey % 9 when 0 then '## '||cast(o_custkey % 4 + 1 as varchar(9))||'.'||cast(o_orderkey % 7 as varchar(9))||'. Results of '||o_orderstatus "
    "when 1 then '# **Overview '||o_orderstatus||'**' when 2 then '' when 3 then '$E_{'||cast(o_orderkey % 5 as varchar(9))||'} = m + 1$' "
    "when 4 then '| part '||cast(o_orderkey % 50 as varchar(9))||' ..... 7 |' when 5 then '| a | b |' when 6 then '### Contents' when 7 then '| c ..... 9 |' else 'Plain text '||cast(o_orderkey as varchar(19)) end as line from {orders}",
    # compiler logs
    "log_lines": "select user_id % 25 as doc_id, row_number() over (partition by user_id % 25 order by event_id) as line_no, case event_id % 11 "
    "when 0 then './main.tex:'||cast(event_id % 90 as varchar(9))||': Undefined control sequence.' when 1 then '! Missing $ inserted.' when 2 then 'l.'||cast(event_id % 70 as varchar(9))||' some text' "
    "when 3 then 'LaTeX Warning: Reference undefined on input line '||cast(event_id % 30 as varchar(9))||'.' when 4 then 'Package babel Warning: No hyphenation patterns' when 5 then 'LaTeX Font Warning: Font shape not available' "
    f"when 6 then {tex('Overfull ~hbox (3.2pt too wide) in paragraph at lines ')}||cast(event_id % 50 as varchar(9))||'--60' when 7 then 'No file: File `'||event_type||'.sty'' not found' when 8 then '! Emergency stop.' when 9 then '[WARNING] Could not convert TeX math' else 'This is ordinary output' end as line from {{events}}",
    # section commands of LaTeX documents
    "tex_lines": "select o_custkey % 30 as doc_id, row_number() over (partition by o_custkey % 30 order by o_orderkey) as line_no, case o_orderkey % 8 "
    f"when 0 then {tex('~chapter{Part ')}||cast(o_orderkey % 10 as varchar(9))||'}}' when 1 then {tex('~section{On ~textbf{')}||o_orderstatus||'}} and more}} tail' when 2 then {tex('  ~subsection*{Case ')}||cast(o_orderkey % 4 as varchar(9))||'}}' "
    f"when 3 then {tex('% ~section{hidden}')} when 4 then {tex('~begin{frame}{Slide ')}||cast(o_orderkey % 6 as varchar(9))||'}}' when 5 then {tex('~subsubsection[short]{Long}')} else 'Some words of text' end as line from {{orders}}",
    # glyph spans: a row of five for each line of a page, with smaller ones above and below
    "spans": "select l_orderkey % 30 as doc_id, cast(l_orderkey % 7 as int) as page_no, cast(l_orderkey as bigint) as line_no, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as span_no, "
    "case l_partkey % 12 when 0 then '∑' when 1 then 'max' when 2 then 'ˆ' else substr('abxyzEfgkn', cast(l_partkey % 10 as int) + 1, 1)||case when l_partkey % 5 = 0 then 'word' else '' end end as text, "
    "case when l_suppkey % 3 = 0 then 'CMMI10' when l_suppkey % 3 = 1 then 'CMR10' else 'CMTT9' end as font, "
    "case when l_partkey % 4 = 0 then 7.0 else 10.0 end as size, cast(l_linenumber * 20 + l_quantity as double) as ox, "
    "cast((cast(floor(l_orderkey / 210.0) as bigint) % 50) * 14 as double) + case when l_partkey % 8 = 0 then -3.0 when l_partkey % 8 = 4 then 2.0 else 0.0 end as oy, "
    "cast(l_linenumber * 20 + l_quantity as double) as x0, cast((cast(floor(l_orderkey / 210.0) as bigint) % 50) * 14 - 7 as double) as y0, cast(l_linenumber * 20 + l_quantity + 8 as double) as x1, cast((cast(floor(l_orderkey / 210.0) as bigint) % 50) * 14 + 3 as double) as y1, cast(l_suppkey % 2 as int) as flags from {lineitem}",
    # thin rectangles, some of them fraction bars
    "drawings": "select o_orderkey % 30 as doc_id, cast(o_orderkey % 7 as int) as page_no, cast(o_orderkey as bigint) as bar_no, cast(o_custkey % 120 as double) as x0, cast((cast(floor(o_orderkey / 210.0) as bigint) % 50) * 14 + 4 as double) as y0, "
    "cast(o_custkey % 120 as double) + cast(o_orderkey % 300 as double) as x1, cast((cast(floor(o_orderkey / 210.0) as bigint) % 50) * 14 + 4 as double) + cast(o_custkey % 5 as double) as y1 from {orders}",
    # readings of a region by a model at several resolutions
    "readings": "select p_partkey % 400 as region_id, cast(150 + 50 * (p_partkey % 3) as int) as dpi, p_partkey as reading_no, "
    f"case when p_size % 4 = 0 then {tex('x ~le y')} when p_size % 4 = 1 then {tex('x ~leq y')} when p_size % 4 = 2 then {tex('~frac{x}{y}')} else 'x + '||cast(p_size % 3 as varchar(3)) end as latex from {{part}}",
    # files of conversion batches
    "files": "select o_custkey % 300 as batch_id, o_orderkey as pos, 'doc'||cast(o_orderkey % 500 as varchar(9))||case o_custkey % 300 % 3 when 0 then '.pdf' when 1 then case when o_orderkey % 2 = 0 then '.docx' else '.pdf' end else '.TEX' end as path from {orders}",
}


def expanded(text: str, name=lambda t: t) -> str:
    """text with {names} of derived inputs replaced by their SQL, and of tables by name(table)."""
    names = "|".join([*DERIVED, *TABLES])
    while True:
        new = re.sub(rf"\{{({names})\}}", lambda m: f"({DERIVED[m[1]]})" if m[1] in DERIVED else name(m[1]), text)
        if new == text:
            return text
        text = new


def rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of a SQL text, or of the table or derived input of that name."""
    reachable(spark)
    if text in DERIVED or text in TABLES:
        text = f"select * from {{{text}}}"
    return spark.sql(expanded(text, lambda t: f"parquet.`{sf_dir}/{t}.parquet`").replace("varchar(3)", "string").replace("varchar(9)", "string").replace("varchar(19)", "string"))
