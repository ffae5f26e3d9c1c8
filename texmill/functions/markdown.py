"""Markdown clean-up as column expressions on lines and on whole texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed patterns of the clean-up.
HEADING = r"^(#{1,6})\s+(.*?)\s*$"
NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+(\S.*)$"
EMPHASIS = r"^(?:\*\*|__)(.*?)(?:\*\*|__)$"
DOT_LEADER = r"(?:\.[ \t]*){3,}"
TOC_TITLE = r"(?i)^#{1,6}\s*(?:\*\*|__)?\s*(?:\d+[.\s]*)?(índice|indice|contenido|contents|table of contents|tabla de contenido)s?\s*(?:\*\*|__)?\s*$"
PICTURE_TEXT = r"(?s)\*{0,2}-{3,}\s*Start of picture text\s*-{3,}\*{0,2}.*?\*{0,2}-{3,}\s*End of picture text\s*-{3,}\*{0,2}(?:<br>)?"
PAGE_NUMBER = r"^\s*\d{1,4}\s*$"
IMAGE = r"!\[([^\]]*)\]\(([^)\n]+)\)"


def stripped(text: Column) -> Column:
    """Without white space at both ends, of any Unicode kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def heading(line: Column) -> Column:
    """A heading line at the level that its number tells, three at most, without number and emphasis; other lines as they are."""
    title = stripped(F.regexp_extract(line, HEADING, 2))
    title = F.when(title.rlike(EMPHASIS), stripped(F.regexp_extract(title, EMPHASIS, 1))).otherwise(title)
    number = F.regexp_extract(title, NUMBERED, 1)
    level = F.when(number != "", F.least(F.lit(3), F.size(F.split(number, r"\.")))).otherwise(F.length(F.regexp_extract(line, HEADING, 1)))
    rest = F.when(number != "", stripped(F.regexp_extract(title, NUMBERED, 2))).otherwise(title)
    made = F.when(rest == "", "").otherwise(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), rest))
    return F.when(line.rlike(HEADING), made).otherwise(line)


def logo(text: Column) -> Column:
    """The scattered logos of TeX and LaTeX as commands."""
    text = F.regexp_replace(text, r"L\s*[\[{]?A[\]}]?\s*TEX|LATEX|LaTeX", r"\\LaTeX{}")
    return F.regexp_replace(text, r"(?<![A-Za-z\\])TEX(?![A-Za-z])", r"\\TeX{}")


def without_picture_text(text: Column) -> Column:
    return F.regexp_replace(text, PICTURE_TEXT, "")


def clean(text: Column) -> Column:
    """Rules, dot leaders, line ends, page numbers and long gaps taken out; one line end at the end."""
    text = F.regexp_replace(text, r"(?md)^-{3,}\s*$", "")
    text = F.regexp_replace(text, DOT_LEADER, " ")
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    lines = F.transform(lines, lambda x: F.when(x.rlike(PAGE_NUMBER), "").otherwise(x))
    text = F.regexp_replace(F.array_join(lines, "\n"), r"\n{4,}", "\n\n\n")
    return F.concat(stripped(text), F.lit("\n"))


def relative(path: Column, base: Column) -> Column:
    """An absolute path with forward slashes as seen from a folder."""
    a, b = F.split(path, "/"), F.split(F.rtrim(base, F.lit("/")), "/")
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.coalesce(F.nullif(F.array_position(equal, F.lit(False)).cast("int"), F.lit(0)) - 1, F.size(equal))
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(b) - shared), F.slice(a, shared + 1, F.size(a))), "/")


def images(text: Column, base: Column | None = None) -> Column:
    """Links of local images with forward slashes, absolute ones as seen from the folder base; those to the web and inline data stay."""
    links = F.array_distinct(F.regexp_extract_all(text, F.lit(IMAGE), F.lit(0)))
    target = lambda x: stripped(F.regexp_extract(x, IMAGE, 2))
    local = F.filter(links, lambda x: ~target(x).rlike(r"^(http://|https://|data:)"))

    def moved(x: Column) -> Column:
        path = F.replace(target(x), F.lit("\\"), F.lit("/"))
        seen = path if base is None else F.when(path.startswith("/"), relative(path, base)).otherwise(path)
        return F.concat(F.lit("!["), F.regexp_extract(x, IMAGE, 1), F.lit("]("), seen, F.lit(")"))

    return F.aggregate(local, text, lambda acc, x: F.replace(acc, x, moved(x)))


def pages(spec: Column) -> Column:
    """Sorted distinct page indexes from 0 of a selection such as 1-5,8; null for none; raises for what it cannot read."""
    parts = F.filter(F.transform(F.split(spec, ","), stripped), lambda x: x != "")
    bad = F.exists(parts, lambda x: ~x.rlike(r"^\d+\s*(-\s*\d+)?$"))
    ends = lambda x: F.transform(F.split(x, "-"), lambda y: stripped(y).cast("int"))
    runs = F.transform(parts, lambda x: F.sequence(F.array_min(ends(x)), F.array_max(ends(x))))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten(runs), lambda p: p - 1), lambda p: p >= 0)))
    chosen = F.when(bad, F.raise_error(F.concat(F.lit("page selection not understood: "), spec)).cast("array<int>"))
    chosen = chosen.when(F.size(found) == 0, F.raise_error(F.lit("empty page selection")).cast("array<int>")).otherwise(found)
    return F.when(spec.isNull() | (stripped(spec) == ""), F.lit(None)).otherwise(chosen)
