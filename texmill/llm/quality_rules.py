"""Quality rules: word, line and symbol statistics, and robust multivariate outliers among them.

Each (lang, source) group gets a minimum-covariance-determinant estimate of location and scatter. From three fits that need no
chance (median absolute deviations, the covariance of spatial signs, that of clipped deviations) concentration steps go on:
keep the share `core` of the rows that lie nearest, take their mean and covariance, measure again. After `trial_steps` the fit
of least determinant goes on alone until no group's determinant moves. The rows within a chi-square quantile of it then give
the final, reweighted mean and covariance. A document is rejected if its squared Mahalanobis distance exceeds `cut`.
DataFrame operations only.

The statistics all vary in clean text: word length, shares of capitals, marks and short words, numbers of words and of
distinct words. The last two are nearly collinear, so it is the covariance that tells repetition; `ridge` only keeps it regular.

Defined cases: null text is the empty text. A text without words has zero statistics and fails the base rules. Null lang
or source is a group value like any other. Rows of equal statistics count once in the estimates, so copies do not make a core.
Groups of under `min_group` such rows are pooled by language, then over all; if even that pool is too small nothing in it is
rejected. Rows that tie at the edge of the core are all in it. Repeated rows are judged one by one and alike. Other columns are
kept in _doc, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from texmill.llm.text import packed, whole, words
from texmill.storage import stash

#: Characters that count as symbols; fixed by the contract.
SYMBOLS = "#*$%&|<>"
#: ASCII punctuation, for a character class.
MARKS = r"!-/:-@\[-`{-~"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    core: float = 0.6
    trial_steps: int = 2
    #: Steps end when no group's log determinant moves by more than `settled`, or here.
    most_steps: int = 20
    settled: float = 0.05
    #: Quantile that a row of the reweighted estimate lies within.
    near: float = 0.975
    min_group: int = 60
    #: Largest squared distance that is kept: ten deviations. Clean texts' tails are far heavier than Gaussian ones.
    cut: float = 100.0
    #: Standard deviation that is added to each statistic, as a share of its typical spread in a group.
    ridge: float = 0.05
    #: Most groups whose fits are broadcast; beyond, they are joined like any table.
    broadcast_groups: int = 20_000


def chi2_cdf(x: float, d: float) -> float:
    """Lower regularised gamma function of d/2 at x/2, by its series."""
    a, z = d / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, d: float) -> float:
    low, high = 0.0, 10.0 * d + 200
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return (low + high) / 2


def repeated_words(hashes: Column) -> Column:
    """Positions covered by windows that occur twice or more, from the array of window hashes of a text."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    with_before = F.zip_with(
        ordered, F.concat(nothing, ordered), lambda x, y: F.struct(x["h"].alias("h"), x["i"].alias("i"), (x["h"] == y["h"]).alias("again"))
    )
    found = F.zip_with(with_before, F.slice(ordered, 2, F.size(hashes)), lambda x, y: F.when(x["again"] | (x["h"] == y["h"]), x["i"]))
    at = F.sort_array(F.filter(found, lambda i: i.isNotNull()))
    gaps = F.zip_with(at, F.slice(at, 2, F.size(hashes)), lambda i, j: F.least(F.lit(WINDOW), F.coalesce(j - i, F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0), lambda total, n: total + n)


def statistics(docs: DataFrame) -> DataFrame:
    """docs(_doc, _text) with the counts of each text as longs instead of _text."""
    only = lambda text, kept: F.regexp_replace(text, f"[^{kept}]+", "")
    split = docs.select("_doc", whole(F.col("_text")).alias("_t")).withColumn("_w", words(F.col("_t")))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.when(
        F.size("_w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_w"), i, WINDOW)))
    )
    long = lambda c, name: c.cast("long").alias(name)
    counted = split.select(
        "_doc",
        long(F.size("_w"), "n_words"),
        long(F.length(F.array_join("_w", "")), "word_chars"),
        long(F.size(F.array_distinct("_w")), "n_distinct"),
        long(F.size(F.filter("_w", lambda w: F.length(w) <= 3)), "n_short"),
        long(F.length(only(F.col("_t"), "A-Z")), "n_upper"),
        only(F.col("_t"), MARKS).alias("_m"),
        lines.alias("_l"),
        hashes.alias("_h"),
    )
    return counted.select(
        "_doc",
        *("n_words", "word_chars", "n_distinct", "n_short", "n_upper"),
        long(F.length("_m"), "n_marks"),
        long(F.length(only(F.col("_m"), SYMBOLS)), "n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l")), "n_dup_lines"),
        long(F.when(F.size(F.array_distinct("_h")) < F.size("_h"), repeated_words(F.col("_h"))).otherwise(0), "n_repeat_words"),
    )


#: The counts that vector() is made of.
COUNTS = ("n_words", "word_chars", "n_distinct", "n_short", "n_upper", "n_marks")


def rates() -> dict[str, Column]:
    """Rates whose medians in a group vector() draws short texts towards."""
    of = lambda n, d: F.col(n) / F.greatest(F.col(d), F.lit(1))
    return {"r_length": of("word_chars", "n_words"), "r_upper": of("n_upper", "word_chars"), "r_marks": of("n_marks", "word_chars"), "r_short": of("n_short", "n_words")}


def vector() -> dict[str, Column]:
    """Transformed statistics: roots and a logarithm of rates that count as if the text had some more of the group's own."""
    drawn = lambda n, of, rate, more: (F.col(n) + more * F.col(rate)) / (F.col(of) + more)
    return {
        "v_length": F.log(F.greatest(drawn("word_chars", "n_words", "r_length", 20.0), F.lit(1e-9))),
        "v_upper": F.sqrt(drawn("n_upper", "word_chars", "r_upper", 100.0)),
        "v_marks": F.sqrt(drawn("n_marks", "word_chars", "r_marks", 100.0)),
        "v_short": F.sqrt(drawn("n_short", "n_words", "r_short", 100.0)),
        "v_distinct": F.log(F.greatest(F.col("n_distinct"), F.lit(1))),
        "v_words": F.log(F.greatest(F.col("n_words"), F.lit(1))),
    }


#: Expressions on arrays are SQL text from here on: built one Column at a time, they would take the driver longer than the jobs.
def _listed(parts) -> str:
    return f"array({', '.join(parts)})"


def _sides(d: int) -> list[tuple[int, int]]:
    """Places of a lower triangle, row by row, as all arrays below hold it."""
    return [(i, j) for i in range(d) for j in range(i + 1)]


def _at(matrix: str, i: str, j: str) -> str:
    return f"coalesce(get({matrix}, cast({i} * ({i} + 1) / 2 as int) + {j}), 0D)"


def _by_entry(d: int, entry: str) -> str:
    """A triangle made entry by entry: entry is told of the place p and of the entries before, acc."""
    places = _listed(f"named_struct('i', {i}, 'j', {j})" for i, j in _sides(d))
    return f"aggregate({places}, cast(array() as array<double>), (acc, p) -> concat(acc, array({entry})))"


def _factor(matrix: str, d: int) -> str:
    """Cholesky factor of a symmetric matrix."""
    done = f"aggregate(sequence(0, {d - 1}), 0D, (t, k) -> t + if(k < p.j, {_at('acc', 'p.i', 'k')} * {_at('acc', 'p.j', 'k')}, 0D))"
    rest = f"({_at(matrix, 'p.i', 'p.j')} - {done})"
    return _by_entry(d, f"if(p.i = p.j, sqrt(greatest({rest}, 1e-18D)), {rest} / {_at('acc', 'p.j', 'p.j')})")


def _inverse(factor: str, d: int) -> str:
    """Inverse of a lower triangle."""
    done = f"aggregate(sequence(0, {d - 1}), 0D, (t, k) -> t + if(k >= p.j and k < p.i, {_at(factor, 'p.i', 'k')} * {_at('acc', 'k', 'p.j')}, 0D))"
    return _by_entry(d, f"(if(p.i = p.j, 1D, 0D) - {done}) / {_at(factor, 'p.i', 'p.i')}")


def _fit(sums: DataFrame, keys: list[str], centre: str, matrix: str, d: int) -> DataFrame:
    """keys, centre, whitening (the inverse of the covariance's factor) and log_det, of a row for each of keys."""
    made = sums.selectExpr(*keys, f"{centre} as centre", f"{_factor(matrix, d)} as factor")
    log_det = f"aggregate(sequence(0, {d - 1}), 0D, (t, i) -> t + 2 * ln({_at('factor', 'i', 'i')}))"
    return made.selectExpr(*keys, "centre", f"{_inverse('factor', d)} as whitening", f"{log_det} as log_det")


def _away(names: list[str]) -> list[str]:
    return [f"({v} - centre[{k}])" for k, v in enumerate(names)]


def _distance(names: list[str]) -> Column:
    """Squared distance from the centre and whitening beside the values."""
    away = _away(names)
    row = lambda i: " + ".join(f"whitening[{i * (i + 1) // 2 + k}] * {away[k]}" for k in range(i + 1))
    return F.expr(" + ".join(f"pow({row(i)}, 2D)" for i in range(len(names))))


def _moments(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A row for each of keys: the centre, the means a of values, and the lower triangle c of their covariances, from sums of products."""
    sides = _sides(len(values))
    sums = rows.groupBy(*keys, "centre").agg(F.expr(_listed(f"avg({x})" for x in values)).alias("a"), F.expr(_listed(f"avg({values[i]} * {values[j]})" for i, j in sides)).alias("p"))
    return sums.selectExpr(*keys, "centre", "a", _listed(f"p[{k}] - a[{i}] * a[{j}]" for k, (i, j) in enumerate(sides)) + " as c")


def _quantiles(values: list[str], share: float) -> str:
    return _listed(f"percentile_approx({v}, {share}, 1000)" for v in values)


def estimated(slim: DataFrame, names: list[str], rules: Rules = Rules(), few=lambda df: df) -> DataFrame:
    """group, centre, whitening, log_det: the reweighted estimate of each group of slim(group, names), which is read again
    and again, so should be written. few marks a table of a row or three a group as fit for a broadcast."""
    d, away = len(names), _away(names)
    middle = stash(slim.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.expr(_quantiles(names, 0.5)).alias("centre")))
    spread = slim.join(few(middle), "group").groupBy("group", "centre", "n").agg(F.expr(_quantiles([f"abs({y}) * 1.4826D" for y in away], 0.5)).alias("spread"))
    spread = stash(spread)
    typical = spread.agg(F.expr(_listed(f"sum(spread[{i}] * n) / sum(n)" for i in range(d)))).first()[0]  # one row
    ridge = [rules.ridge * (1e-4 + (x or 0.0)) for x in typical]
    upon = _listed(f"{ridge[i] ** 2!r}D" if i == j else "0D" for i, j in _sides(d))
    ridged = lambda matrix, scale=1.0: f"zip_with({matrix}, {upon}, (x, r) -> x * {scale!r}D + r)"

    wide = slim.join(few(spread), "group")
    width = [f"(spread[{i}] + {ridge[i]!r}D)" for i in range(d)]
    length = f"sqrt({' + '.join(f'pow({y} / {w}, 2D)' for y, w in zip(away, width, strict=True))} + 1e-12D)"
    signs = [f"{y} / {length}" for y in away]
    clipped = [f"least(greatest({y} / {w}, -1.5D), 1.5D) * {w}" for y, w in zip(away, width, strict=True)]
    alone = _listed(f"spread[{i}] * spread[{i}]" if i == j else "0D" for i, j in _sides(d))
    fit = _fit(spread, ["group"], "centre", ridged(alone), d).withColumn("start", F.lit(0))
    for k, values in enumerate((signs, clipped), 1):
        fit = fit.unionByName(_fit(_moments(wide, ["group"], values), ["group"], "centre", ridged("c"), d).withColumn("start", F.lit(k)))
    fit = few(stash(fit))

    def moved_to(core: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
        return few(stash(_fit(_moments(core, keys, away), keys, "zip_with(centre, a, (x, y) -> x + y)", ridged("c", scale), d)))

    def step(fit: DataFrame) -> DataFrame:
        keys = [c for c in ("group", "start") if c in fit.columns]
        d2 = _distance(names)
        edges = slim.join(fit, "group").groupBy(*keys).agg(F.percentile_approx(d2, rules.core, 1000).alias("edge"))
        return moved_to(slim.join(few(fit.join(edges, keys)), "group").filter(d2 <= F.col("edge")), keys)

    for _ in range(rules.trial_steps):
        fit = step(fit)
    best = fit.groupBy("group").agg(F.min(F.struct("log_det", "start", "centre", "whitening")).alias("b"))
    fit = few(stash(best.select("group", "b.centre", "b.whitening", "b.log_det")))
    for _ in range(rules.most_steps):
        after = step(fit)
        moved = after.selectExpr("group", "log_det as now").join(fit, "group").agg(F.expr("max(abs(now - log_det))")).first()[0]
        fit = after
        if (moved or 0.0) <= rules.settled:
            break

    shrunk = rules.core / chi2_cdf(chi2_quantile(rules.core, d), d + 2)  # the core alone understates the scatter
    edge = chi2_quantile(rules.near, d)
    return moved_to(slim.join(fit, "group").filter(_distance(names) <= edge * shrunk), ["group"], rules.near / chi2_cdf(edge, d + 2))


def groups(unique: DataFrame, min_group: int) -> DataFrame:
    """For each (_lang, _source) of unique its group: itself, or the pool of those too small; null if the pool is too small."""
    own = F.to_json(F.struct(F.lit("own").alias("k"), F.col("_lang"), F.col("_source")))
    pool = F.to_json(F.struct(F.lit("lang").alias("k"), F.col("_lang")))
    sizes = stash(unique.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n")))
    small = sizes.filter(F.col("n") < min_group).withColumn("pool", pool)
    pools = small.groupBy("pool").agg(F.sum("n").alias("in_pool"))
    in_rest = pools.agg(F.sum(F.when(F.col("in_pool") < min_group, F.col("in_pool")))).first()[0] or 0
    last = F.lit("rest" if in_rest >= min_group else None).cast("string")
    placed = small.join(pools, "pool").select("_lang", "_source", F.when(F.col("in_pool") >= min_group, F.col("pool")).otherwise(last).alias("group"))
    return stash(sizes.filter(F.col("n") >= min_group).select("_lang", "_source", own.alias("group")).unionByName(placed))


def judged(docs: DataFrame, rules: Rules = Rules(), with_text: bool = False) -> DataFrame:
    """_doc: the columns of docs (text only if asked for); the counts, base_failed, d2 and kept. docs needs text, lang, source."""
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    made = vector()
    rows = docs.select(packed(docs, with_text), F.col("text").alias("_text"))
    rows = stash(statistics(rows).withColumn("base_failed", failed).withColumns({"_lang": F.col("_doc.lang"), "_source": F.col("_doc.source")}))
    unique = stash(rows.filter(~F.col("base_failed")).select("_lang", "_source", *COUNTS).distinct())
    at = groups(unique, rules.min_group)
    n_groups = at.count()
    few = lambda df: F.broadcast(df) if n_groups <= rules.broadcast_groups else df
    placing = at.withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    same = F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s"))
    counts = unique.join(few(placing), same).filter(F.col("group").isNotNull()).select("group", *COUNTS)
    typical = few(stash(counts.groupBy("group").agg(*(F.percentile_approx(c, 0.5, 1000).alias(r) for r, c in rates().items()))))
    slim = stash(counts.join(typical, "group").select("group", *(c.alias(v) for v, c in made.items())))
    fit = estimated(slim, list(made), rules, few)

    placed = rows.join(few(placing), same, "left").join(typical, "group", "left").withColumns(made).join(fit, "group", "left")
    out = placed.withColumn("d2", _distance(list(made)))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= rules.cut))
    return out.select("_doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "base_failed", "d2", "kept")
