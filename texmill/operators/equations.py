"""Pieces of displayed equations put together, and texts with parts of them replaced: ordered folds over small arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from texmill.functions import layout as f
from texmill.functions.formulas import tolerant
from texmill.operators.layout import LINE, PAGE

# Fixed patterns.
BIG = r"\\(?:int|iint|iiint|oint|sum|prod|coprod|big[a-z]+)"
OPEN_END = BIG + r"(?:[\^_]\{[^{}]*\})*\s*$"
ATOM = r"\\[A-Za-z]+|\\.|[^\s{}^_&$]"
STRUCTURE = (
    r"\frac \dfrac \tfrac \left \right \big \Big \bigg \Bigg \mathrm \text \mathbb \mathcal \mathbf \boldsymbol \mathit \mathsf \mathfrak \operatorname \begin \end \\ \, \; \: \! \quad \qquad "
    r"\displaystyle \textstyle \limits \nolimits \underset \overset \mathop \hat \bar \tilde \vec \dot \ddot \widehat \widetilde \overline \underline \sqrt \surd \middle \substack"
).split()


def merged_fragments(fragments: Column) -> Column:
    """Array of fragments as one line: a short one without = right before a big operator is its upper limit."""
    starts = lambda x: F.regexp_extract(x, rf"^({BIG})", 1)
    nothing = F.lit(None).cast("string")

    def step(acc: Column, x: Column) -> Column:
        held, op = acc["held"], starts(x)
        limit = held.isNotNull() & (F.length(held) <= 10) & ~F.contains(held, F.lit("=")) & (op != "")
        joined = F.concat(op, F.lit("^{"), held, F.lit("}"), F.substr(x, F.length(op) + 1, F.length(x)))
        out = F.when(limit, F.concat(acc["out"], F.array(joined))).when(held.isNotNull(), F.concat(acc["out"], F.array(held))).otherwise(acc["out"])
        return F.struct(F.when(limit, nothing).otherwise(x).alias("held"), out.alias("out"))

    start = F.struct(nothing.alias("held"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(fragments, start, step, lambda acc: F.concat(acc["out"], F.array_compact(F.array(acc["held"]))))
    return F.trim(F.array_join(F.filter(done, lambda x: x != ""), " "))


def joined_splits(equations: DataFrame) -> DataFrame:
    """(PAGE, y, latex, n) of equations(PAGE, y, latex): one that begins with a script, or follows an open operator, is part
    of the one before if that one began under 60 above."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "latex")))

    def step(acc: Column, e: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        part = (e["latex"].rlike(r"^[_^]\{") | last["latex"].rlike(OPEN_END)) & (e["y"] - last["y"] < 60)
        whole = F.struct(last["y"].alias("y"), F.concat(last["latex"], e["latex"]).alias("latex"), (last["n"] + 1).alias("n"))
        new = F.struct(e["y"].alias("y"), e["latex"].alias("latex"), F.lit(1).alias("n"))
        return F.when(F.coalesce(part, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(whole))).otherwise(F.concat(acc, F.array(new)))

    start = F.array().cast("array<struct<y:double,latex:string,n:int>>")
    found = equations.groupBy(*PAGE).agg(ordered.alias("e")).select(*PAGE, F.explode(F.aggregate("e", start, step)).alias("e"))
    return found.select(*PAGE, "e.y", "e.latex", "e.n")


def display_lines(spans: DataFrame, widths: DataFrame) -> DataFrame:
    """(LINE, y, share): lines near the middle of their page (widths: PAGE, width) of which 45 % is set as mathematics."""
    n = F.length(F.regexp_replace("text", f.NEUTRAL, ""))
    line = spans.filter(F.trim("text") != "").groupBy(*LINE).agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("oy").alias("y"), F.sum(n).alias("decisive"), F.sum(F.when(f.math_font(F.col("font")), n).otherwise(0)).alias("math")
    )
    off = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("width") / 2) / F.col("width")
    return line.join(widths, PAGE).filter((off < 0.15) & (F.col("decisive") >= 1) & (F.col("math") / F.col("decisive") >= 0.45)).select(*LINE, "y", (F.col("math") / F.col("decisive")).alias("share"))


def atoms(latex: Column) -> Column:
    """Glyphs that a formula draws: tokens without structure, names of functions letter by letter."""
    raw = F.regexp_extract_all(F.regexp_replace(latex, r"\\(begin|end)\{[^{}]*\}", " "), F.lit(ATOM), F.lit(0))
    drawn = F.filter(raw, lambda t: ~t.isin(STRUCTURE))
    spelled = F.transform(drawn, lambda t: F.when(F.substr(t, F.lit(2), F.length(t)).isin(f.FUNCTIONS), F.filter(F.split(F.substr(t, F.lit(2), F.length(t)), ""), lambda c: c != "")).otherwise(F.array(t)))
    return F.flatten(spelled)


def replaced_at(text: Column, parts: Column) -> Column:
    """text with the parts array<struct<start,end,new>> (from 0, end exclusive) replaced, the last first, so that earlier offsets hold."""
    ordered = F.reverse(F.array_sort(parts))
    return F.aggregate(ordered, text, lambda acc, p: F.concat(F.substr(acc, F.lit(1), p["start"]), p["new"], F.substr(acc, p["end"] + 1, F.length(acc))))


def applied(text: Column, fixes: Column) -> Column:
    """text with fixes array<struct<plain,latex>> put in wherever their text is found through Markdown's marks, long ones first."""
    longest = F.array_sort(F.transform(fixes, lambda x: F.struct((-F.length(x["plain"])).alias("n"), x["plain"].alias("plain"), x["latex"].alias("latex"))))
    quoted = lambda s: F.regexp_replace(s, r"([\\$])", r"\\$1")
    return F.aggregate(longest, text, lambda acc, x: F.regexp_replace(acc, tolerant(x["plain"]), quoted(x["latex"])))


def script_fixes(scripts: DataFrame) -> DataFrame:
    """(LINE, span_no, plain, latex) of scripts(LINE, span_no, x0, text, kind): a word and the scripts that hang on it."""
    w = Window.partitionBy(*LINE).orderBy("x0", "span_no")
    base = F.when(F.col("kind").isNull(), F.struct("span_no", F.regexp_extract("text", r"(\S+)$", 1).alias("word")))
    hung = scripts.withColumn("base", F.last(base, ignorenulls=True).over(w)).filter("kind is not null and base.word <> ''")
    each = F.transform(F.array_sort(F.collect_list(F.struct("x0", "span_no", F.trim("text").alias("t"), "kind"))), lambda s: s)
    out = hung.groupBy(*LINE, F.col("base.span_no").alias("span_no"), F.col("base.word").alias("word")).agg(each.alias("s"))
    plain = F.concat("word", F.array_join(F.transform("s", lambda s: s["t"]), ""))
    latex = F.concat(F.lit("$"), "word", F.array_join(F.transform("s", lambda s: F.concat(F.when(s["kind"] == "sup", "^{").otherwise("_{"), s["t"], F.lit("}"))), ""), F.lit("$"))
    made = out.select(*LINE, "span_no", plain.alias("plain"), latex.alias("latex"), F.array_max(F.transform("s", lambda s: F.length(s["t"]))).alias("longest"))
    return made.filter((F.length("plain") >= 2) & ~F.col("plain").rlike(r"^\d+$") & (F.col("longest") <= 12)).drop("longest")


def zipped(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left(key, pos, a) and right(key, pos, b) side by side by place, for keys where both have as many."""
    place = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("pos")))
    same = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("m")), key).filter("n = m").select(key)
    return place(left).join(place(right).drop("pos"), [key, "k"]).join(same, key, "left_semi").select(key, "k", "a", "b")


def sync_points(lines: DataFrame) -> DataFrame:
    """(query_id, page, x, y, width, height) of the first whole box in the lines(query_id, line_no, line) of a position tool."""
    pair = F.regexp_extract("line", r"^(Page|h|v|W|H):\s*(-?\d+(?:\.\d+)?)\s*$", 1)
    value = F.regexp_extract("line", r"^(Page|h|v|W|H):\s*(-?\d+(?:\.\d+)?)\s*$", 2).try_cast("double")
    told = lines.select("query_id", "line_no", pair.alias("k"), value.alias("v")).filter("k <> ''")
    w = Window.partitionBy("query_id").orderBy("line_no")
    names = {"on_page": "Page", "x": "h", "bottom": "v", "wide": "W", "tall": "H"}
    seen = told.select("*", *(F.last(F.when(F.col("k") == k, F.col("v")), ignorenulls=True).over(w).alias(name) for name, k in names.items()))
    whole = seen.filter("k = 'H' and on_page is not null and x is not null and bottom is not null and wide is not null")
    box = F.struct(F.col("on_page").cast("int").alias("page"), "x", F.greatest(F.lit(0.0), F.col("bottom") - F.col("tall")).alias("y"), F.col("wide").alias("width"), F.when(F.col("tall") == 0, 12.0).otherwise(F.col("tall")).alias("height"))
    return whole.groupBy("query_id").agg(F.min_by(box, "line_no").alias("b")).select("query_id", "b.*")


def line_states(lines: DataFrame) -> DataFrame:
    """lines with state at their beginning: normal, math or verbatim, carried from line to line of a document."""
    text = F.col("line")
    opens = F.when(text.rlike(r"\\begin\{(verbatim|lstlisting|minted)"), "verbatim").when(text.rlike(r"\\begin\{(equation|align|gather|multline)|\\\["), "math")
    closes = text.rlike(r"\\end\{(verbatim|lstlisting|minted|equation|align|gather|multline)|\\\]")
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(closes, "normal").otherwise(opens)
    return lines.withColumn("state", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit("normal")))


def unused(files: DataFrame, texts: DataFrame) -> DataFrame:
    """files(doc_id, path) to which no image link of texts(doc_id, text) points."""
    used = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"!\[[^\]]*\]\(([^)\n]+)\)"), F.lit(1))).alias("path"))
    return files.join(used.distinct(), ["doc_id", "path"], "left_anti")


def anchored(chars: DataFrame) -> DataFrame:
    """(LINE, span_no, text, oy, y0) of chars(LINE, span_no, i, c, oy, y0): a span stands where its first visible glyph does."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "c", "oy", "y0")))
    seen = lambda a: F.filter(a, lambda x: F.trim(x["c"]) != "")
    spans = chars.groupBy(*LINE, "span_no").agg(ordered.alias("g"))
    first = F.coalesce(F.get(seen("g"), F.lit(0)), F.get("g", F.lit(0)))
    out = spans.select(*LINE, "span_no", F.array_join(F.transform("g", lambda x: x["c"]), "").alias("text"), first["oy"].alias("oy"), F.array_min(F.transform(seen("g"), lambda x: x["y0"])).alias("y0"))
    return out.filter(F.trim("text") != "")
