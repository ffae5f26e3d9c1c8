"""Formula evaluation: tokens, matches, scores, kinds, worst rows, baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from texmill.functions import tokens as t
from texmill.operators import matching, scoring
from texmill.plans import corpus
from texmill.registry import query

#: DuckDB: tokens of {originals} and {found}, one letter for each kind of token.
_DROP = "['" + "','".join([*t.SPACING, *t.LETTER_FORM]) + "']"
_SAME = "case x " + " ".join(f"when '{a}' then '{b}'" for a, b in t.SYNONYMS.items()) + " else x end"
_RAW = r"regexp_extract_all(text, '\\[a-zA-Z]+\*?|\\.|[^\s]')"
_LINE = f"array_to_string(list_transform(list_filter({_RAW}, lambda x: not list_contains({_DROP}, x)), lambda x: {_SAME}), ' ')"
_ONE = rf"regexp_replace(regexp_replace(regexp_replace({_LINE}, '\{{ ([^{{}} ]+) \}}', '\1', 'g'), '\{{ ([^{{}} ]+) \}}', '\1', 'g'), '( [,.;])+$', '')"
_TOKENS = f"string_split({_ONE}, ' ')"
_ALPHABET = "(select list(distinct x order by x) from (select unnest(tokens) as x from o union all select unnest(tokens) from f))"
_SETS = f"o as (select *, {_TOKENS} as tokens from {{originals}}), f as (select *, {_TOKENS} as tokens from {{found}})"
_MATCH = (
    f"with {_SETS}, abc as (select {_ALPHABET} as abc), "
    "oc as (select o.*, array_to_string(list_transform(tokens, lambda x: chr(cast(33 + list_position(abc, x) as int))), '') as code, count(*) over (partition by doc_id) as n from o, abc), "
    "fc as (select f.*, array_to_string(list_transform(tokens, lambda x: chr(cast(33 + list_position(abc, x) as int))), '') as code, count(*) over (partition by doc_id) as n from f, abc), "
    "p as (select oc.doc_id, oc.seq, fc.seq as found_seq, fc.text as found_text, case when oc.code = fc.code then 1.0::double else 1.0::double - levenshtein(oc.code, fc.code)::double / greatest(length(oc.code), length(fc.code)) end as score "
    "from oc join fc on oc.doc_id = fc.doc_id and abs(fc.seq - round_even(oc.seq * (fc.n::double / oc.n), 0)) <= 40), "
    "b as (select doc_id, seq, arg_max(struct_pack(found_seq, found_text, score), (score, -found_seq)) as best from p where score > 0 group by doc_id, seq), "
    "m as (select oc.*, best.found_seq, best.found_text, coalesce(best.score, 0.0) as score from oc left join b using (doc_id, seq)) "
)
_KINDS = (
    "k as (select score, unnest(list_filter([case when display then 'display' else 'inline' end, case when len(tokens) >= 5 then 'non_trivial' end, "
    r"case when list_has_any(tokens, ['^', '_']) then 'scripts' end, case when list_contains(tokens, '\frac') then 'fractions' end, "
    r"case when list_has_any(tokens, ['\sum', '\int', '\prod', '\oint', '\iint', '\bigcup', '\bigcap']) then 'sums_integrals' end, "
    r"case when list_contains(tokens, '\sqrt') then 'roots' end, case when regexp_matches(text, '\\begin\{(\w*matrix|array|cases)\*?\}') then 'matrices' end], lambda x: x is not null)) as kind from m) "
)
_MEASURES = "count(score) as formulas, round(avg(case when score >= 1 then 100.0 else 0.0 end), 6) as exact_pct, round(100 * avg(score), 6) as similarity_pct"


def _originals(spark, sf_dir):
    return corpus.rows(spark, sf_dir, "originals").withColumn("tokens", t.normalized(F.col("text")))


def _found(spark, sf_dir):
    return corpus.rows(spark, sf_dir, "found").withColumn("tokens", t.normalized(F.col("text")))


def _matches(spark, sf_dir):
    return matching.matched(_originals(spark, sf_dir), _found(spark, sf_dir))


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("exact_pct", "similarity_pct")})


@query(f"select doc_id, seq, array_to_string({_TOKENS}, ' ') as tokens, len({_TOKENS}) as n_tokens from {{originals}}")
def token_normalize(spark, sf_dir):
    return _originals(spark, sf_dir).select("doc_id", "seq", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").cast("long").alias("n_tokens"))


@query(f"with {_SETS}, m as (select *, 0.0 as score from o), {_KINDS} select kind, count(*) as n from k group by kind")
def formula_kinds(spark, sf_dir):
    o = _originals(spark, sf_dir)
    return o.select(F.explode(t.kinds(F.col("tokens"), F.col("text"), F.col("display"))).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(_MATCH + "select doc_id, seq, found_seq, found_text, round(score, 6) as score from m")
def match_band_top1(spark, sf_dir):
    return _matches(spark, sf_dir).select("doc_id", "seq", "found_seq", "found_text", F.round("score", 6).alias("score"))


@query(_MATCH + f"select doc_id, {_MEASURES} from m group by doc_id")
def score_summary(spark, sf_dir):
    return _rounded(_matches(spark, sf_dir).groupBy("doc_id").agg(*scoring.measures(F.col("score"))))


@query(_MATCH + ", " + _KINDS + f"select kind, {_MEASURES} from k group by kind")
def kinds_rollup(spark, sf_dir):
    return _rounded(scoring.by_kind(_matches(spark, sf_dir)))


_COMPILED = "select n_nationkey as doc_id, case when n_nationkey % 7 = 6 then null else n_nationkey % 3 end as errors from {nation} where n_nationkey < 20"


@query(_MATCH + f"select 'total' as kind, count(*) as formulas, round(avg(case when round(score, 4) >= 1 then 100.0 else 0.0 end), 6) as exact_pct, round(100 * avg(round(score, 4)), 6) as similarity_pct, (select sum(errors)::bigint from ({_COMPILED}) e) as latex_errors, (select count(*) from ({_COMPILED}) e where errors = 0) as clean_papers from m")
def score_total(spark, sf_dir):
    return _rounded(scoring.total(_matches(spark, sf_dir), corpus.rows(spark, sf_dir, _COMPILED)))


@query(_MATCH + "select doc_id, seq, text, found_text, round(score, 3) as score from (select * from m qualify row_number() over (partition by doc_id order by m.score, seq) <= 15) w where len(tokens) >= 5")
def worst_k(spark, sf_dir):
    return scoring.worst(_matches(spark, sf_dir)).select("doc_id", "seq", "text", "found_text", F.round("score", 3).alias("score"))


_BASELINE = "select kind, exact_pct from (values ('display', 50.0), ('inline', 80.0), ('fractions', 70.5)) b(kind, exact_pct)"


@query(
    _MATCH + ", " + _KINDS + f", r as (select kind, {_MEASURES} from k group by kind) "
    f"select r.kind, r.exact_pct, b.exact_pct::double as baseline_pct, case when abs(r.exact_pct - b.exact_pct) < 0.05 then 0.0 else round(r.exact_pct - b.exact_pct::double, 6) end as change from r left join ({_BASELINE}) b on r.kind = b.kind"
)
def baseline_delta(spark, sf_dir):
    baseline = spark.createDataFrame([("display", 50.0), ("inline", 80.0), ("fractions", 70.5)], "kind string, exact_pct double")
    report = _rounded(scoring.by_kind(_matches(spark, sf_dir)))
    return scoring.against(report, baseline).select("kind", "exact_pct", "baseline_pct", F.round("change", 6).alias("change"))


@query(
    _MATCH + ", " + _KINDS + f", r as (select kind, {_MEASURES} from k group by kind) select row_number() over (order by formulas desc, kind) as place, kind, formulas from r"
)
def sort_kinds(spark, sf_dir):
    from pyspark.sql import Window

    ordered = Window.orderBy(F.desc("formulas"), "kind")  # a row a kind
    return scoring.by_kind(_matches(spark, sf_dir)).select(F.row_number().over(ordered).cast("long").alias("place"), "kind", "formulas")


@query(_MATCH + ", " + _KINDS + f"select kind, {_MEASURES} from k group by kind union all select 'total', {_MEASURES} from m")
def formula_report(spark, sf_dir):
    """The evaluation end to end: tokens, band match, scores, by kind and in all."""
    return _rounded(scoring.report(_matches(spark, sf_dir))).select("kind", "formulas", "exact_pct", "similarity_pct")
