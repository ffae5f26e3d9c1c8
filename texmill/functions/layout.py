"""Predicates and boxes of glyph spans. Y grows downward; a box is x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed patterns and constants.
MATH_FONT = (
    r"(?i)CMMI|CMSY|CMEX|CMBSY|MSAM|MSBM|EUSM|EUFM|RSFS|MathItalic|MathSymbol|MathExtension|MathJax|STIX.*Math|XITSMath|Cambria\s*Math|Asana.*Math|Math\b|Symbol|StandardSym|"
    r"NewTX|NewPX|tx(?:sy|ex|mia)|px(?:sy|ex|mia)|ntx(?:mi|sy|ex)|npx(?:mi|sy|ex)|EUR[MB]|EUEX|MnSymbol"
)
EXTENSION_FONT = r"(?i)MathExtension|CMEX|LMEX|txex|pxex|ntxex|npxex|EUEX"
MONO_FONT = r"(?i)Mono|Courier|Consol|Menlo|Code|CMTT|SFTT|LMTT|t1xtt|TT\d"
NEUTRAL = r"[()\[\]{}0-9+\-=.,;:!/|<> \t]"
FUNCTIONS = "sin cos tan cot sec csc sinh cosh tanh coth arcsin arccos arctan log ln lg exp lim liminf limsup max min sup inf det dim ker deg gcd arg hom".split()
OPERATORS = {"∑": r"\sum", "∏": r"\prod", "∐": r"\coprod", "⋃": r"\bigcup", "⋂": r"\bigcap", "∫": r"\int"}
LIMIT_WORDS = "lim liminf limsup max min sup inf".split()
ACCENTS = {"ˆ": r"\hat", "^": r"\hat", "˜": r"\tilde", "~": r"\tilde", "¯": r"\bar", "ˉ": r"\bar", "˙": r"\dot", "¨": r"\ddot", "ˇ": r"\check", "˘": r"\breve", "→": r"\vec", "\u20d7": r"\vec"}
BAR_WIDTH, BAR_HEIGHT = (5.0, 260.0), 2.2


def _map(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def math_font(font: Column) -> Column:
    return font.rlike(MATH_FONT)


def extension_font(font: Column) -> Column:
    return font.rlike(EXTENSION_FONT)


def mono(font: Column, flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(8)).cast("boolean") | font.rlike(MONO_FONT)


def script_kind(size: Column, oy: Column, base_size: Column, base_y: Column) -> Column:
    """sup or sub of a span against the size and baseline of its line; null for neither."""
    dy = oy - base_y
    small = (base_size > 0) & (size < base_size - 0.4)
    return F.when(small & (dy < -0.14 * base_size), "sup").when(small & (dy > 0.08 * base_size), "sub")


def text_word(text: Column, font: Column) -> Column:
    """Not in a mathematical font, with a word of two letters or more that is no function."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0))
    return ~math_font(font) & F.exists(words, lambda w: ~w.isin(FUNCTIONS))


def radical(text: Column, font: Column) -> Column:
    mark = F.trim(text)
    return (mark == "√") | (mark.isin(*"pqrs") & extension_font(font))


def accent(text: Column) -> Column:
    return _map(ACCENTS, F.trim(text))


def operator(text: Column, font: Column) -> Column:
    """Command of a lone big operator in a mathematical font, or of a word that takes limits below; else null."""
    mark = F.trim(F.regexp_replace(text, "[\\uFE00-\\uFE0F]", ""))
    return F.coalesce(F.when(math_font(font), _map(OPERATORS, mark)), F.when(mark.isin(LIMIT_WORDS), F.concat(F.lit("\\"), mark)))


def bar(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Short, thin and level: what may be the bar of a fraction."""
    width, height = x1 - x0, y1 - y0
    return width.between(*BAR_WIDTH) & (height <= BAR_HEIGHT) & (width >= 4 * height)


def inside(a: str, b: str, slack: float = 1.5) -> Column:
    """Box a.x0.. lies in box b.x0.. but for some slack; a and b are prefixes of column names."""
    c = lambda p, n: F.col(p + n)
    return (c(a, "x0") >= c(b, "x0") - slack) & (c(a, "x1") <= c(b, "x1") + slack) & (c(a, "y0") >= c(b, "y0") - slack) & (c(a, "y1") <= c(b, "y1") + slack)


def overlap(a: str, b: str) -> Column:
    c = lambda p, n: F.col(p + n)
    return (c(a, "x0") < c(b, "x1")) & (c(a, "x1") > c(b, "x0")) & (c(a, "y0") < c(b, "y1")) & (c(a, "y1") > c(b, "y0"))
