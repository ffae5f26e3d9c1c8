"""LaTeX sources, logs and counts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from texmill.functions.markdown import stripped

# Fixed patterns and lists.
FILE_LINE = r"^([^\s:]{1,200}\.\w{1,6}):(\d+):\s*(.+)$"
BANG = r"^!\s*(.+)$"
LINE_HINT = r"^l\.(\d+)"
WARNING = r"^(?:LaTeX|Package|Class)\s*([\w@-]+)?\s*Warning:\s*(.+)$"
BOXES = r"^(Overfull|Underfull) \\[hv]box .*?(?:at lines? (\d+)|in paragraph at lines? (\d+))"
MISSING_FILE = r"File `([^']+)' not found"
NOISE = r"(?i)Font shape|has changed|Some font shapes|Marginpar|Package hyperref Warning: Token not allowed|Package microtype Warning|rerunfilecheck"
NOT_PROSE = (
    "equation align gather multline eqnarray displaymath array matrix bmatrix pmatrix vmatrix cases split "
    "verbatim lstlisting minted alltt tikzpicture picture tabular tabularx longtable thebibliography"
).split()
SILENCED = ("1", "8", "13", "17", "36", "44")
PACKAGES = "amsmath amssymb graphicx booktabs longtable array float textcomp enumitem xcolor hyperref".split()
SECTION = r"^[ \t]*\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\s*(?:\[[^\]]*\])?\{(.*)$"
FRAME = r"^[ \t]*\\begin\{frame\}(?:\[[^\]]*\])?\s*\{(.*)$"
LEVELS = {"part": 0, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}


def balanced_title(rest: Column) -> Column:
    """What stands before the brace that closes a title, without commands, braces, dollars and backslashes."""

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        shut = acc["shut"] | (depth == 0)
        return F.struct(depth.alias("depth"), shut.alias("shut"), F.when(shut, acc["out"]).otherwise(F.concat(acc["out"], c)).alias("out"))

    start = F.struct(F.lit(1).alias("depth"), F.lit(False).alias("shut"), F.lit("").alias("out"))
    inner = F.aggregate(F.filter(F.split(rest, ""), lambda c: c != ""), start, step, lambda acc: acc["out"])
    return stripped(F.regexp_replace(F.regexp_replace(inner, r"\\[A-Za-z]+\*?\s*", ""), r"[{}$\\]", ""))


def body(text: Column) -> Column:
    """Between \\begin{document} and \\end{document}; from the start or to the end where one is missing."""
    after = F.substring_index(text, "\\begin{document}", 1)
    rest = F.when(F.contains(text, F.lit("\\begin{document}")), F.substr(text, F.length(after) + 17, F.length(text))).otherwise(text)
    return F.substring_index(rest, "\\end{document}", 1)


def word_count(text: Column) -> Column:
    """Words of the prose of a document: no preamble, comments, mathematics, code, tables or commands."""
    out = F.regexp_replace(body(text), r"(?<!\\)%[^\n]*", " ")
    for name in NOT_PROSE:
        out = F.regexp_replace(out, rf"(?s)\\begin\{{{name}\*?\}}.*?\\end\{{{name}\*?\}}", " ")
    for pattern in (r"(?s)\$\$.*?\$\$", r"(?<!\\)\$(?:[^$\\\n]|\\.)*\$", r"(?s)\\\[.*?\\\]", r"\\[A-Za-z@]+\*?(?:\[[^\]\n]*\])?", r"\\[^A-Za-z]", r"[{}&#_^~]"):
        out = F.regexp_replace(out, pattern, " ")
    return F.size(F.filter(F.split(out, r"(?U)\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))


def count_math(text: Column) -> Column:
    """About how many formulas a document has."""
    return (
        F.regexp_count(text, F.lit(r"(?<!\\)\$(?:[^$\\]|\\.)+\$"))
        + F.regexp_count(text, F.lit(r"\\\((?s:.*?)\\\)"))
        + F.regexp_count(text, F.lit(r"\\\[|\\begin\{(?:equation|align|gather|multline)"))
    )


def remaining(text: Column) -> Column:
    """Sorted distinct characters that a LaTeX engine of 8 bits may not know; comments don't count."""
    shown = F.regexp_replace(text, r"(?<!\\)%[^\n]*", "")
    odd = F.regexp_extract_all(shown, F.lit("[^\\x00-\\x7F\\u00A0-\\u024F\\u1E00-\\u1EFF\\uE000-\\uE0FFˆˇ˘˙˚˛˜˝–—‘’‚“”„†‡•…‰‹›€™]"), F.lit(0))
    return F.array_sort(F.array_distinct(odd))


def bibliography(text: Column) -> Column:
    """Names of the .bib files that a document asks for."""
    groups = F.regexp_extract_all(text, F.lit(r"\\(?:bibliography|addbibresource)\s*\{([^}]*)\}"), F.lit(1))
    names = F.filter(F.transform(F.split(F.array_join(groups, ","), ","), stripped), lambda x: x != "")
    return F.transform(names, lambda x: F.when(F.lower(x).endswith(".bib"), x).otherwise(F.concat(F.regexp_replace(x, r"(?<=[^/.])\.[^./]*$", ""), F.lit(".bib"))))


def missing_packages(text: Column) -> Column:
    """PACKAGES that no \\usepackage of the text names, in order."""
    absent = [F.when(~text.rlike(rf"\\usepackage(?:\[[^\]]*\])?\{{[^}}]*\b{p}\b[^}}]*\}}"), F.lit(p)) for p in PACKAGES]
    return F.array_compact(F.array(*absent))


def with_packages(text: Column) -> Column:
    """Missing packages put before \\begin{document}; a text without it stays as it is."""
    lines = F.array_join(F.transform(missing_packages(text), lambda p: F.concat(F.lit("\\usepackage{"), p, F.lit("}"))), "\n")
    at = F.locate("\\begin{document}", text)
    put = F.concat(F.substr(text, F.lit(1), at - 1), F.lit("\n"), lines, F.lit("\n\n"), F.substr(text, at, F.length(text)))
    return F.when((at == 0) | (F.size(missing_packages(text)) == 0), text).otherwise(put)


def tidied(text: Column) -> Column:
    """Control characters and what a converter leaves behind taken out."""
    text = F.regexp_replace(text, r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]", "")
    text = F.replace(text, F.lit("\\tightlist\n"), F.lit(""))
    text = F.regexp_replace(text, r"\\providecommand\{\\tightlist\}\{%?\s*\n?\s*\\setlength\{\\itemsep\}\{0pt\}\\setlength\{\\parskip\}\{0pt\}\}\s*\n?", "")
    return F.regexp_replace(text, r"\n{4,}", "\n\n\n")


def two_columns(text: Column) -> Column:
    """Long tables as tables over both columns."""
    text = F.replace(text, F.lit("\\begin{longtable}"), F.lit("\\begin{table*}[htbp]\n\\centering\n\\begin{tabular}"))
    text = F.replace(text, F.lit("\\end{longtable}"), F.lit("\\end{tabular}\n\\end{table*}"))
    for command in ("\\endhead", "\\endfirsthead", "\\endfoot", "\\endlastfoot"):
        text = F.replace(text, F.lit(command + "\n"), F.lit(""))
    return text


def human_size(n: Column) -> Column:
    """Bytes in the largest unit of 1024 that leaves 1 or more."""
    unit = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, name in ((1, "KB"), (2, "MB")):
        unit = unit.when(n < 1024 ** (k + 1), F.concat(F.format_string("%.1f", n / float(1024**k)), F.lit(f" {name}")))
    return unit.otherwise(F.concat(F.format_string("%.1f", n / float(1024**3)), F.lit(" GB")))
