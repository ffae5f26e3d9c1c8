"""Document analytics: logs, outlines, counts, searches, packages, source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from texmill.functions import latex as tx
from texmill.functions.markdown import stripped
from texmill.operators import documents as ops
from texmill.plans import corpus
from texmill.plans.corpus import tex
from texmill.registry import query
from texmill.sources import texts as src

_PROBLEMS = (
    rf"with l as (select doc_id, line_no, rtrim(line) as x from {{log_lines}}), k as (select *, case when regexp_matches(x, '{tx.FILE_LINE}') and not regexp_matches(lower(x), '^(package|latex)') then 'file' when regexp_matches(x, '{tx.BANG}') then 'bang' "
    rf"when regexp_matches(x, '{tx.LINE_HINT}') then 'hint' when regexp_matches(x, '{tx.WARNING}') and not regexp_matches(x, '{tx.NOISE}') then 'warning' when regexp_matches(x, '{tx.MISSING_FILE.replace(chr(39), chr(39) * 2)}') then 'missing' end as kind from l), "
    "n as (select *, lead(kind) over w as nk, lead(x) over w as nx from k where kind is not null window w as (partition by doc_id order by line_no)), "
    rf"p as (select doc_id, line_no, case when kind = 'warning' then 'warning' else 'error' end as severity, case kind when 'file' then trim(regexp_extract(x, '{tx.FILE_LINE}', 3)) when 'bang' then trim(regexp_extract(x, '{tx.BANG}', 1)) "
    rf"when 'warning' then case when regexp_extract(x, '{tx.WARNING}', 1) <> '' then '['||regexp_extract(x, '{tx.WARNING}', 1)||'] ' else '' end||trim(regexp_extract(x, '{tx.WARNING}', 2)) else 'file not found: '||regexp_extract(x, '{tx.MISSING_FILE.replace(chr(39), chr(39) * 2)}', 1) end as message, "
    rf"case when kind = 'file' then regexp_extract(x, '{tx.FILE_LINE}', 1) end as file, try_cast(nullif(case kind when 'file' then regexp_extract(x, '{tx.FILE_LINE}', 2) when 'bang' then case when nk = 'hint' then regexp_extract(nx, '{tx.LINE_HINT}', 1) end "
    r"when 'warning' then regexp_extract(x, 'on input line (\d+)', 1) end, '') as int) as line from n where kind <> 'hint'), "
    "u as (select * from p qualify row_number() over (partition by doc_id, severity, message, line order by line_no) = 1) "
)


@query(_PROBLEMS + "select * from u")
def log_problems(spark, sf_dir):
    return ops.log_problems(corpus.rows(spark, sf_dir, "log_lines"))


@query(_PROBLEMS + "select doc_id, severity, count(*) as n from u group by all")
def problem_summary(spark, sf_dir):
    return ops.log_problems(corpus.rows(spark, sf_dir, "log_lines")).groupBy("doc_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, count(*) as n_errors, arg_min(regexp_extract(line, '^! (.+)$', 1), line_no) as first_error from {log_lines} where regexp_matches(line, '^! (.+)$') group by doc_id")
def log_errors(spark, sf_dir):
    bang = corpus.rows(spark, sf_dir, "log_lines").filter(F.col("line").rlike("^! (.+)$"))
    return bang.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_errors"), F.min_by(F.regexp_extract("line", "^! (.+)$", 1), "line_no").alias("first_error"))


#: The logs, but that odd documents name no file with their errors, so that bare ones count.
_ERROR_LINES = "select doc_id, line_no, case when doc_id % 2 = 1 and line like './main.tex:%' then 'note '||line else line end as line from {log_lines}"
_ERRORS = rf"""
with log as ({_ERROR_LINES}), f as (select doc_id, line_no, regexp_extract(line, '^([^\s:]+\.\w+):(\d+): (.+)$', 1)||':'||regexp_extract(line, '^([^\s:]+\.\w+):(\d+): (.+)$', 2)||': '||regexp_extract(line, '^([^\s:]+\.\w+):(\d+): (.+)$', 3) as message
  from log where regexp_matches(line, '^([^\s:]+\.\w+):(\d+): (.+)$')),
b as (select doc_id, line_no, regexp_extract(line, '^! (.+)$', 1) as message from log where regexp_matches(line, '^! (.+)$') and doc_id not in (select doc_id from f)),
m as (select doc_id, line_no + 1000000000 as line_no, 'missing package: '||regexp_extract(line, 'File `([^'']+\.sty)'' not found', 1) as message from log where regexp_matches(line, 'File `([^'']+\.sty)'' not found'))
select doc_id, min(line_no) as place, message from (select * from f union all select * from b union all select * from m) x group by doc_id, message
"""


@query(_ERRORS)
def compile_errors(spark, sf_dir):
    """Errors with file and line; only where a log has none, bare errors; then missing packages."""
    return _compile_errors(corpus.rows(spark, sf_dir, _ERROR_LINES))


def _compile_errors(lines):
    pattern, sty = r"^([^\s:]+\.\w+):(\d+): (.+)$", r"File `([^']+\.sty)' not found"
    get = lambda k: F.regexp_extract("line", pattern, k)
    placed = lines.filter(F.col("line").rlike(pattern) & ~F.lower(stripped(get(3))).rlike("^(warning|info)"))
    placed = placed.select("doc_id", "line_no", F.concat(get(1), F.lit(":"), get(2), F.lit(": "), get(3)).alias("message"))
    bare = lines.filter(F.col("line").rlike("^! (.+)$")).join(placed.select("doc_id").distinct(), "doc_id", "left_anti")
    bare = bare.select("doc_id", "line_no", F.regexp_extract("line", "^! (.+)$", 1).alias("message"))
    missing = lines.filter(F.col("line").rlike(sty)).select("doc_id", (F.col("line_no") + 1_000_000_000).alias("line_no"), F.concat(F.lit("missing package: "), F.regexp_extract("line", sty, 1)).alias("message"))
    return placed.unionByName(bare).unionByName(missing).groupBy("doc_id", "message").agg(F.min("line_no").alias("place"))


_LINT = "select n_nationkey as doc_id, cast(n_nationkey * 3 as varchar(9))||':'||cast(n_regionkey as varchar(9))||':'||cast(n_nationkey % 14 as varchar(9))||': Message: about '||n_name as line from {nation} union all select 99 as doc_id, 'no finding here' as line"


@query(f"select doc_id, cast(split_part(line, ':', 1) as int) as line, trim(split_part(line, ':', 3)) as code, trim(array_to_string(string_split(line, ':')[4:], ':')) as message from ({_LINT}) x where regexp_matches(line, '^\\d+:[^:]*:[^:]*:') and trim(split_part(line, ':', 3)) not in ('1', '8', '13', '17', '36', '44')")
def lint_filter(spark, sf_dir):
    return ops.lint(corpus.rows(spark, sf_dir, _LINT))


_OUTLINE = (
    rf"with h as (select doc_id, line_no, case when regexp_matches(line, '{tx.FRAME}') then 3 else list_position(['part', 'chapter', 'section', 'subsection', 'subsubsection', 'paragraph'], regexp_extract(line, '{tx.SECTION}', 1)) - 1 end as level, "
    rf"case when regexp_matches(line, '{tx.FRAME}') then regexp_extract(line, '{tx.FRAME}', 1) else regexp_extract(line, '{tx.SECTION}', 2) end as rest from {{tex_lines}} where not starts_with(ltrim(line), '%')), "
    r"t as (select doc_id, line_no, level, trim(regexp_replace(regexp_replace(regexp_extract(rest, '^((?:[^{}]|\{[^{}]*\})*)\}', 1), '\\[A-Za-z]+\*?\s*', '', 'g'), '[{}$\\]', '', 'g')) as title from h where level is not null) "
)


@query(_OUTLINE + "select t.*, (select max(p.line_no) from t p where p.doc_id = t.doc_id and p.line_no < t.line_no and p.level < t.level) as parent_line from t")
def outline_tree(spark, sf_dir):
    return ops.outline(ops.headings(corpus.rows(spark, sf_dir, "tex_lines")))


@query(_OUTLINE + "select doc_id, line_no, level, title from t")
def outline_headings(spark, sf_dir):
    return ops.headings(corpus.rows(spark, sf_dir, "tex_lines"))


_PROSE = r"regexp_replace(text, '%[^\n]*', ' ', 'g')"
for _pattern in (r"(?s)\$\$.*?\$\$", r"\$(?:[^$\\\n]|\\.)*\$", r"(?s)\\\[.*?\\\]", r"\\[A-Za-z@]+\*?(?:\[[^\]\n]*\])?", r"\\[^A-Za-z]", r"[{}&#_^~]"):
    _PROSE = f"regexp_replace({_PROSE}, '{_pattern}', ' ', 'g')"


@query(rf"select doc_id, len(list_filter(regexp_split_to_array({_PROSE}, '\s+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]'))) as n_words from {{documents}}")
def word_count(spark, sf_dir):
    docs = corpus.rows(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.word_count(F.col("text")).cast("long").alias("n_words"))


_WHOLE = f"select n_nationkey as doc_id, {tex('~documentclass{article}^^Intro~begin{document}^^Some ~emph{words} of ')}||n_name||{tex('^^% a comment^^~begin{equation}x=1~end{equation} and $y$ more ~% text ~end{document} tail')} as text from {{nation}}"


@query(f"select doc_id, 8 as n_words from ({_WHOLE}) x")
def word_count_tex(spark, sf_dir):
    return corpus.rows(spark, sf_dir, _WHOLE).select("doc_id", tx.word_count(F.col("text")).alias("n_words"))


@query(r"select doc_id, len(regexp_extract_all(text, '\$(?:[^$\\]|\\.)+\$')) as n_formulas from {documents}")
def count_math(spark, sf_dir):
    return corpus.rows(spark, sf_dir, "documents").select("doc_id", tx.count_math(F.col("text")).cast("long").alias("n_formulas"))


_ODD = "select n_nationkey as doc_id, n_name||' α → β’ é ≤'||case when n_nationkey % 2 = 0 then '∑' else '' end||chr(10)||'% ∞ hidden' as text from {nation}"


@query(f"select doc_id, case when doc_id % 2 = 0 then 'α β → ∑ ≤' else 'α β → ≤' end as characters from ({_ODD}) x")
def remaining_chars(spark, sf_dir):
    return corpus.rows(spark, sf_dir, _ODD).select("doc_id", F.array_join(tx.remaining(F.col("text")), " ").alias("characters"))


@query("select lang, ch, count(*) as n, count(distinct doc_id) as n_docs from (select lang, doc_id, unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) as ch from {documents}) x group by all")
def char_inventory(spark, sf_dir):
    each = corpus.rows(spark, sf_dir, "documents").select("lang", "doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x00-\x7F]"), F.lit(0))).alias("ch"))
    per_doc = each.groupBy("lang", "ch", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("lang", "ch").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query("select sum(hits)::bigint as total, min(case when hits > 0 then page_id end) as first_page, count_if(hits > 0) as pages from (select page_id, len(regexp_extract_all(html, '(?i)<p')) as hits from {pages}) x")
def search_pages(spark, sf_dir):
    hits = ops.search(corpus.rows(spark, sf_dir, "pages").withColumnRenamed("html", "text"), "(?i)<p", "page_id")
    return hits.agg(F.sum("hits").cast("long").alias("total"), F.min(F.when(F.col("hits") > 0, F.col("page_id"))).alias("first_page"), F.count_if(F.col("hits") > 0).alias("pages"))


@query("select conv_id, turn, len(regexp_extract_all(text, '(?i)the')) as n, md5(regexp_replace(text, '(?i)the', 'THE', 'g')) as digest from {conversations}")
def find_replace(spark, sf_dir):
    rows = corpus.rows(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.regexp_count("text", F.lit("(?i)the")).cast("long").alias("n"), F.md5(F.regexp_replace("text", "(?i)the", "THE").cast("binary")).alias("digest"))


_TEXCOUNT = "select o_orderkey, cast(o_orderkey % 90 as varchar(9))||case when o_orderkey % 3 = 0 then '' else '+'||cast(o_custkey % 9 as varchar(9))||'+'||cast(o_orderkey % 4 as varchar(9))||' file' end as line from {orders}"


@query(f"select o_orderkey, case when regexp_matches(line, '^\\d+$') then line::bigint else list_sum(list_transform(regexp_extract_all(line, '\\d+')[1:3], lambda x: x::bigint))::bigint end as total from ({_TEXCOUNT}) x")
def texcount_total(spark, sf_dir):
    line = F.col("line")
    parts = F.transform(F.array(*(F.regexp_extract(line, r"^(\d+)\+(\d+)\+(\d+)", k) for k in (1, 2, 3))), lambda x: x.try_cast("long"))
    total = F.when(line.rlike(r"^\d+$"), line.try_cast("long")).otherwise(F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x))
    return corpus.rows(spark, sf_dir, _TEXCOUNT).select("o_orderkey", total.alias("total"))


_DOCX = "select s_suppkey, repeat('<m:oMath>x</m:oMath><m:oMathPara>', cast(s_suppkey % 5 as int))||repeat('<m:oMath a=\"1\">', cast(s_suppkey % 3 as int)) as document_xml from {supplier}"


@query("select s_suppkey, s_suppkey % 5 + s_suppkey % 3 as equations from {supplier}")
def docx_counts(spark, sf_dir):
    return corpus.rows(spark, sf_dir, _DOCX).select("s_suppkey", F.regexp_count("document_xml", F.lit("<m:oMath[ >]")).cast("long").alias("equations"))


@query("with w as (select doc_id, count(*) as formulas from {log_lines} where starts_with(line, '[WARNING]') group by doc_id), d as (select doc_id, case when starts_with(line, '[WARNING]') then 0 else 1 end as others from {log_lines} where line_no = 1) select doc_id, coalesce(formulas, 0) as formulas, others from d left join w using (doc_id)")
def converter_warnings(spark, sf_dir):
    """Formulas that a conversion could not read, and its other messages, for each whole log."""
    return ops.converter_warning_counts(corpus.rows(spark, sf_dir, "log_lines"))


_BIB = f"select n_nationkey, {tex('~bibliography{')}||n_name||', refs.bib ,}} and '||{tex('~addbibresource{old.')}||cast(n_regionkey as varchar(9))||'}}' as text from {{nation}}"


@query("select n_nationkey, n_name||'.bib|refs.bib|old.bib' as files from {nation}")
def bibliography_files(spark, sf_dir):
    return corpus.rows(spark, sf_dir, _BIB.replace("}}", "}").replace("{{", "{")).select("n_nationkey", F.array_join(tx.bibliography(F.col("text")), "|").alias("files"))


_PACKAGES = f"select p_partkey, {tex('~documentclass{article}^^~usepackage[x]{')}||case p_size % 3 when 0 then 'amsmath,amssymb' when 1 then 'float' else 'xcolor' end||{tex('}^^~begin{document}^^Text^^~end{document}')} as text from {{part}}"


@query("select p_partkey, case p_size % 3 when 0 then 'graphicx booktabs longtable array float textcomp enumitem xcolor hyperref' when 1 then 'amsmath amssymb graphicx booktabs longtable array textcomp enumitem xcolor hyperref' else 'amsmath amssymb graphicx booktabs longtable array float textcomp enumitem hyperref' end as packages from {part}")
def missing_packages(spark, sf_dir):
    return corpus.rows(spark, sf_dir, _PACKAGES).select("p_partkey", F.array_join(tx.missing_packages(F.col("text")), " ").alias("packages"))


@query(f"select p_partkey, case p_size % 3 when 0 then 9 else 10 end as added from {{part}}")
def ensure_packages(spark, sf_dir):
    made = corpus.rows(spark, sf_dir, _PACKAGES).withColumn("new", tx.with_packages(F.col("text")))
    count = F.regexp_count(F.substring_index("new", "\\begin{document}", 1), F.lit(r"\\usepackage\{")) - F.regexp_count(F.substring_index("text", "\\begin{document}", 1), F.lit(r"\\usepackage\{"))
    return made.select("p_partkey", count.alias("added"))


_NOISE = f"select n_nationkey, n_name||chr(7)||{tex('~tightlist^^a^^^^^^^^^^b ~begin{longtable}x~endhead^^~end{longtable}')} as text from {{nation}}"


@query(f"select n_nationkey, n_name||{tex('a^^^^^^b ~begin{table*}[htbp]^^~centering^^~begin{tabular}x~end{tabular}^^~end{table*}')} as text from {{nation}}")
def generated_tex_cleanup(spark, sf_dir):
    return corpus.rows(spark, sf_dir, _NOISE).select("n_nationkey", tx.two_columns(tx.tidied(F.col("text"))).alias("text"))


@query("select n_nationkey, n_nationkey * n_nationkey * 700 as bytes, case when n_nationkey * n_nationkey * 700 < 1024 then cast(n_nationkey * n_nationkey * 700 as varchar)||' B' else format('{:.1f} KB', n_nationkey * n_nationkey * 700 / 1024.0) end as size from {nation}")
def human_size(spark, sf_dir):
    n = (F.col("n_nationkey") * F.col("n_nationkey") * 700).alias("bytes")
    return corpus.rows(spark, sf_dir, "nation").select("n_nationkey", n, tx.human_size(n).alias("size"))


_FILES = f"select n_regionkey as doc_id, n_name||'.tex' as path, case when n_nationkey % 2 = 0 then {tex('~documentclass{a}')} else '' end||repeat('x', cast(n_nationkey as int))||{tex('~begin{document} ~input{one}')} as text from {{nation}}"


@query(f"select doc_id, path, text from ({_FILES}) x where contains(text, chr(92)||'documentclass') qualify row_number() over (partition by doc_id order by length(text) desc, path desc) = 1")
def main_tex(spark, sf_dir):
    return ops.main_sources(corpus.rows(spark, sf_dir, _FILES))


_TREE = (
    f"select r_regionkey as doc_id, 'main.tex' as path, 'A '||{tex('~input{one}')}||' B '||{tex('~include{gone.tex}')}||r_name as text from {{region}} union all select r_regionkey as doc_id, 'one.tex' as path, {tex('[~input{sub/two.tex}]')} as text from {{region}} "
    "union all select r_regionkey as doc_id, 'sub/two.tex' as path, 'two of '||r_name as text from {region}"
)


@query("select r_regionkey as doc_id, 'A [two of '||r_name||'] B '||r_name as text from {region}")
def include_flatten(spark, sf_dir):
    return src.flattened(corpus.rows(spark, sf_dir, _TREE), "main.tex")


@query("select distinct user_id, event_type, first_value(event_id) over (partition by user_id, event_type order by event_id) as event_id, first_value(value) over (partition by user_id, event_type order by event_id) as value from {events}")
def first_occurrence(spark, sf_dir):
    rows = corpus.rows(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return ops.first_of(rows, ["user_id", "event_type"], "event_id")


@query("select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[-8:], chr(10)) as tail from {documents}")
def log_tail(spark, sf_dir):
    filled = F.filter(F.split("text", "\n"), lambda x: stripped(x) != "")
    last = F.slice(filled, F.greatest(F.size(filled) - 7, F.lit(1)), 8)
    return corpus.rows(spark, sf_dir, "documents").select("doc_id", F.array_join(last, "\n").alias("tail"))

