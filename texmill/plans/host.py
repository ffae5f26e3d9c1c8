"""Conversion batches, options, names, encodings, lists and appendices."""

from __future__ import annotations

from pyspark.sql import functions as F

from texmill.operators import conversions as ops
from texmill.plans import corpus
from texmill.plans.corpus import tex
from texmill.registry import query
from texmill.sources import texts as src


@query(
    "with k(source, target, rank) as (values ('.pdf', '.docx', 0), ('.pdf', '.tex', 1), ('.tex', '.pdf', 2), ('.tex', '.docx', 3), ('.docx', '.tex', 4), ('.docx', '.pdf', 5)), f as (select *, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) as source from {files}), "
    "t as (select batch_id, count(*) as n, arg_min(source, pos) as source from f group by batch_id), a as (select batch_id, target, count(*) as able from f join k using (source) group by all) "
    "select t.batch_id, coalesce(string_agg(k.target, ' ' order by k.rank) filter (able = n), '') as targets from t left join k using (source) left join a on a.batch_id = t.batch_id and a.target = k.target group by t.batch_id"
)
def targets_common(spark, sf_dir):
    return ops.common_targets(corpus.rows(spark, sf_dir, "files")).select("batch_id", F.array_join("targets", " ").alias("targets"))


@query("select pos, path, case lower(regexp_extract(path, '(\\.[^./]*)$', 1)) when '.pdf' then 'pdf2tex' when '.docx' then 'docx2tex' end as key from {files}")
def conversion_to(spark, sf_dir):
    return ops.conversion_of(corpus.rows(spark, sf_dir, "files").select("pos", "path"), ".tex")


_OPTIONS = "select p_partkey, case p_size % 3 when 0 then 'tex2docx' when 1 then 'pdf2tex' else 'docx2pdf' end as key from {part}"


@query(f"select p_partkey, key, case key when 'tex2docx' then 'toc' when 'pdf2tex' then 'pages' else 'engine' end as options from ({_OPTIONS}) x")
def options_kept(spark, sf_dir):
    given = F.create_map(*(F.lit(x) for pair in (("toc", "1"), ("pages", "1-3"), ("engine", "x"), ("color", "red")) for x in pair))
    return corpus.rows(spark, sf_dir, _OPTIONS).select("p_partkey", "key", F.array_join(F.map_keys(ops.accepted(F.col("key"), given)), " ").alias("options"))


_JOBS = "select o_custkey % 200 as batch_id, o_orderkey as pos, case o_orderkey % 7 when 0 then 'failed' when 1 then 'cancelled' else 'done' end as state from {orders}"


@query(f"select batch_id, count_if(state = 'done') as done, count_if(state = 'failed') as failed, count_if(state = 'cancelled') as cancelled, count(*) as total, case when count_if(state = 'failed') > 0 then 1 else 0 end as exit_code from ({_JOBS}) x group by all")
def batch_status(spark, sf_dir):
    return ops.batch_status(corpus.rows(spark, sf_dir, _JOBS))


@query(f"select batch_id, pos, state, row_number() over (partition by batch_id order by pos)||' of '||count(*) over (partition by batch_id) as label from ({_JOBS}) x")
def batch_labels(spark, sf_dir):
    return ops.numbered(corpus.rows(spark, sf_dir, _JOBS))


@query("select path, pos, case when n = 0 then path else regexp_extract(path, '^(.*?)(\\.[^.]*)?$', 1)||'_'||n||regexp_extract(path, '^(.*?)(\\.[^.]*)?$', 2) end as name from (select path, pos, row_number() over (partition by path order by pos) - 1 as n from {files}) x")
def unique_names(spark, sf_dir):
    return src.unique_names(corpus.rows(spark, sf_dir, "files").select("path", "pos"))


_IDS = "select n_nationkey, case n_nationkey % 4 when 0 then '# all comment' when 1 then '  ' else ' 21'||cast(n_nationkey as varchar(9))||'.5 # about '||n_name end as line from {nation}"


@query("select '21'||n_nationkey||'.5' as id from {nation} where n_nationkey % 4 > 1")
def paper_list(spark, sf_dir):
    return src.ids(corpus.rows(spark, sf_dir, _IDS))


@query("select doc_id::varchar as path, 'utf-8' as encoding, 'lf' as newline, md5(text) as digest from {documents}")
def encoding_guess(spark, sf_dir):
    docs = corpus.rows(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return src.decoded(docs).select("path", "encoding", "newline", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("select doc_id::varchar as path, case when regexp_matches(text, '[^\\x00-\\x7F]') then 'cp1252' else 'utf-8' end as encoding, 'crlf' as newline, md5(text) as digest from {documents} where contains(text, chr(10))")
def encoding_single_byte(spark, sf_dir):
    """Texts of one code page with line ends of two characters: undecodable as UTF-8, read by the code page."""
    docs = corpus.rows(spark, sf_dir, "documents").filter(F.contains("text", F.lit("\n")))
    blobs = docs.select(F.col("doc_id").cast("string").alias("path"), src.encoded(F.col("text"), F.lit("latin-1"), F.lit("crlf")).alias("content"))
    return src.decoded(blobs).select("path", "encoding", "newline", F.md5(F.col("text").cast("binary")).alias("digest"))


_LEFT = f"select n_nationkey, {tex('a ~end{document} b ~end{document}^^')} as text, n_name from {{nation}}"


@query(f"select n_nationkey, {tex('a ~end{document} b % eq 1 ')}||n_name||chr(10)||'% eq 2'||chr(10)||{tex('~end{document}^^')} as text from {{nation}}")
def appendix(spark, sf_dir):
    comments = F.array(F.concat(F.lit("eq 1 "), F.col("n_name")), F.lit("eq 2"))
    return corpus.rows(spark, sf_dir, _LEFT).select("n_nationkey", src.appendix(F.col("text"), comments).alias("text"))


@query("select n_nationkey, 3 as formulas, n_name as title, 'b' as mode from {nation}")
def stats_merge(spark, sf_dir):
    """Statistics of two steps as one map; the later step wins."""
    one = F.create_map(F.lit("formulas"), F.lit("1"), F.lit("title"), F.col("n_name"))
    two = F.create_map(F.lit("formulas"), F.lit("3"), F.lit("mode"), F.lit("b"))
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    both = F.map_concat(one, two)
    return corpus.rows(spark, sf_dir, "nation").select("n_nationkey", both["formulas"].cast("int").alias("formulas"), both["title"].alias("title"), both["mode"].alias("mode"))


@query("select event_type, count(*) as n from {events} group by all")
def failures_do_not_stop(spark, sf_dir):
    """Jobs run each for itself; an error is a row with its class."""

    def job(row):
        if row["event_id"] % 5 == 0:
            raise ValueError("bad input")
        return row["event_id"]

    done = ops.outcomes(corpus.rows(spark, sf_dir, "events").select("event_id", "event_type"), job)
    return done.groupBy("event_type").agg(F.count_if(F.col("ok") | (F.col("error_class") == "ValueError")).alias("n"))
