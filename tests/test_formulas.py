"""Formula sources: tokens, macros, extraction, similarity, kinds, matches."""

import pytest
from pyspark.sql import functions as F

from texmill.functions import formulas as fm
from texmill.functions import tokens as tk
from texmill.operators import matching


def tokens_of(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tk.normalized(F.col("t")).alias("k"))
    return [r.k for r in df.orderBy("i").collect()]


@pytest.mark.parametrize(
    ("a", "b"),
    [
        (r"x^{2}", "x^2"),
        (r"a \le b", r"a\leq b"),
        (r"\left( x \right)", "(x)"),
        (r"\mathrm{d}\, x", "{d}x"),
        (r"f^{\prime}", "f'"),
        (r"x = 1,.", "x=1"),
        (r"\label{eq:{a}}y", "y"),
        (r"\dfrac{{a}}{b}{}", r"\frac ab"),
        (r"\phantom xz", "z"),
    ],
)
def test_same_look_same_tokens(spark, a, b):
    left, right = tokens_of(spark, a, b)
    assert left == right


@pytest.mark.parametrize(("a", "b"), [("x^2", "x_2"), (r"\frac{a}{b}", "ab"), (r"\alpha", r"\beta"), (r"\{x\}", "x")])
def test_other_look_other_tokens(spark, a, b):
    left, right = tokens_of(spark, a, b)
    assert left != right


def test_tokens_of_nothing_and_null(spark):
    assert tokens_of(spark, "", "  ", r"\,", None) == [[], [], [], None]


def test_extraction_of_every_delimiter():
    text = r"""\begin{document} $a$ \(b\) $$c \\ d$$ \[e\] \begin{align*}f &= 1 \\ g\end{align*}
\begin{verbatim} $no$ \end{verbatim} \$5 % $hidden$
\begin{equation}\begin{matrix}1 \\ 2\end{matrix}\end{equation} \begin{math}m\end{math} $t\$u$ $open"""
    found = list(fm.formulas(text))
    assert [t for t, _ in found] == ["a", "b", "c", "d", "e", "f &= 1", "g", r"\begin{matrix}1 \\ 2\end{matrix}", "m", r"t\$u"]
    assert [d for _, d in found] == [False, False, True, True, True, True, True, True, False, False]


def test_macros_with_and_without_arguments():
    text = r"\newcommand{\R}{\mathbb{R}} \renewcommand\half[1]{\frac{#1}{2}} \def\two#1#2{#2#1} \DeclareMathOperator{\tr}{tr} \newcommand{\opt}[1][x]{y} $\R \half{z} \two ab \tr \opt \Rx$"
    known = fm.macros(text)
    assert known == {r"\R": (0, r"\mathbb{R}"), r"\half": (1, r"\frac{#1}{2}"), r"\two": (2, "#2#1"), r"\tr": (0, r"\operatorname{tr}")}
    ((formula, _),) = fm.of_source(text)
    assert formula.split() == [r"\mathbb{R}", r"\frac{z}{2}", "ba", r"\operatorname{tr}", r"\opt", r"\Rx"]


def test_macro_that_calls_itself_ends():
    assert r"\a" in fm.expanded(r"\a", {r"\a": (0, r"x\a")})


def test_similarity(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a", "b"], ["a", "c"]), (["a"], []), ([], []), ([r"\alpha", "x"], [r"\beta", "y"])], "a array<string>, b array<string>")
    abc = F.array(*map(F.lit, ("a", "b", "c", r"\alpha", r"\beta", "x", "y")))
    got = df.select(tk.similarity(tk.letters(F.col("a"), abc), tk.letters(F.col("b"), abc)).alias("s"))
    assert [r.s for r in got.collect()] == [1.0, 0.5, 0.0, 1.0, 0.0]


def rows_of(spark, texts):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, seq int, text string")
    return df.withColumn("tokens", F.split("text", " ")).withColumn("display", F.lit(False))


def test_best_match_first_on_ties_and_none(spark):
    got = matching.matched(rows_of(spark, ["a b", "c d", "q"]), rows_of(spark, ["c d", "a b", "a b"]), band=40).orderBy("seq").collect()
    assert [(r.found_seq, r.score) for r in got] == [(1, 1.0), (0, 1.0), (None, 0.0)]


def test_nothing_found(spark):
    got = matching.matched(rows_of(spark, ["a b"]), rows_of(spark, ["x"]).filter("false")).collect()
    assert [(r.found_text, r.score) for r in got] == [(None, 0.0)]


def test_band_pairs_equal_brute_force(spark):
    left = spark.range(300).selectExpr("id % 2 as doc_id", "id div 2 as seq")
    right = spark.range(240).selectExpr("id % 2 as doc_id", "id div 2 as seq")
    got = {(r.doc_id, r.seq, r.found_seq) for r in matching.band_pairs(left, right, 5).collect()}
    want = {(d, i, j) for d in (0, 1) for i in range(150) for j in range(120) if abs(j - round(i * (120 / 150))) <= 5}
    assert got == want
