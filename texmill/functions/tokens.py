"""Formula text as tokens, without what does not change how it looks; array folds on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Which commands count as spacing or size, as layout with an argument, as letter form, and as synonyms.
SPACING = (
    r"\left \right \middle \displaystyle \textstyle \scriptstyle \scriptscriptstyle \limits \nolimits "
    r"\big \Big \bigg \Bigg \bigl \bigr \Bigl \Bigr \biggl \biggr \Biggl \Biggr \bigm \Bigm "
    r"\, \; \: \! \quad \qquad ~ \nonumber \notag & \allowbreak \nobreak"
).split() + ["\\ "]
WITH_ARGUMENT = r"\label \tag \hspace \vspace \hspace* \vspace* \phantom \hphantom \vphantom".split()
LETTER_FORM = r"\mathrm \text \textrm \mbox \textnormal \operatorname \mathit \textit \mathnormal \hbox".split()
SYNONYMS = dict(
    pair.split(" ")
    for pair in (
        r"\le \leq|\ge \geq|\ne \neq|\to \rightarrow|\gets \leftarrow|\lbrace \{|\rbrace \}|\lVert \@|\rVert \@|\Vert \@|"
        r"\ldots \dots|\cdots \dots|\dotsc \dots|\dotsb \dots|\dotsm \dots|\colon :|\lbrack [|\rbrack ]|\land \wedge|"
        r"\lor \vee|\lnot \neg|\ast *|\dfrac \frac|\tfrac \frac|\varepsilon \epsilon|\varphi \phi|\emptyset \varnothing"
    ).replace(r"\@", "\\\x7f").split("|")
) | {c: "|" for c in (r"\vert", r"\lvert", r"\rvert", r"\mid")}
SYNONYMS = {k: v.replace("\x7f", "|") for k, v in SYNONYMS.items()}
TOKEN = r"\\[a-zA-Z]+\*?|\\.|[^\s]"


def strip_comments(text: Column) -> Column:
    """Without % and the rest of its line, unless a backslash stands before it."""
    return F.regexp_replace(text, r"(?<!\\)%[^\n]*", "")


def _literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _unbraced(tokens: Column) -> Column:
    """Groups of no token removed, and of one token opened, inner ones first; a fold that looks at the end of its output."""

    def step(out: Column, t: Column) -> Column:
        n = F.size(out)
        last, before = F.try_element_at(out, F.lit(-1)), F.try_element_at(out, F.lit(-2))
        empty = (t == "}") & (last == "{")
        single = (t == "}") & (before == "{") & ~last.isin("{", "}")
        return F.when(empty, F.slice(out, 1, F.greatest(n - 1, F.lit(0)))).when(single, F.concat(F.slice(out, 1, F.greatest(n - 2, F.lit(0))), F.array(last))).otherwise(F.concat(out, F.array(t)))

    return F.aggregate(tokens, F.array().cast("array<string>"), step)


def normalized(formula: Column) -> Column:
    """Array of the tokens of a formula that decide how it looks. Null gives null."""
    raw = F.regexp_extract_all(formula, F.lit(TOKEN), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("argument"), F.array().cast("array<string>").alias("out"))
    table = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    dropped = _literals(SPACING + LETTER_FORM)

    def step(acc: Column, t: Column) -> Column:
        inside = acc["depth"] > 0
        depth = F.when(acc["argument"], F.when(t == "{", 1).otherwise(0)).when(inside, acc["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)).otherwise(0)
        skip = acc["argument"] | inside
        opens = ~skip & F.array_contains(_literals(WITH_ARGUMENT), t)
        keep = ~skip & ~opens & ~F.array_contains(dropped, t)
        out = F.when(keep, F.concat(acc["out"], F.array(F.coalesce(F.try_element_at(table, t), t)))).otherwise(acc["out"])
        return F.struct(depth.alias("depth"), opens.alias("argument"), out.alias("out"))

    line = F.array_join(_unbraced(F.aggregate(raw, start, step, lambda acc: acc["out"])), " ")
    line = F.regexp_replace(line, r"(?<=^|\s)\^ \\prime(?=\s|$)", "'")
    line = F.regexp_replace(line, r"(?:(?:^|\s)[,.;])+$", "")
    return F.filter(F.split(line, " "), lambda t: t != "")


def kinds(tokens: Column, text: Column, display: Column) -> Column:
    """Labels of a formula; one formula may have several."""
    has = lambda *names: F.arrays_overlap(tokens, _literals(names))
    when = lambda test, name: F.when(test, F.lit(name))
    return F.array_compact(
        F.array(
            F.when(display, F.lit("display")).otherwise(F.lit("inline")),
            when(F.size(tokens) >= 5, "non_trivial"),
            when(has("^", "_"), "scripts"),
            when(has(r"\frac"), "fractions"),
            when(has(r"\sum", r"\int", r"\prod", r"\oint", r"\iint", r"\bigcup", r"\bigcap"), "sums_integrals"),
            when(has(r"\sqrt"), "roots"),
            when(text.rlike(r"\\begin\{(\w*matrix|array|cases)\*?\}"), "matrices"),
        )
    )


def letters(tokens: Column, alphabet: Column) -> Column:
    """Tokens as a string of one letter each, the token's place in alphabet; equal tokens and no others share a letter."""
    code = lambda t: F.lit(0x4E00) + F.array_position(alphabet, t)  # noqa: E731  beyond the surrogates for up to 35,000
    return F.array_join(F.transform(tokens, lambda t: F.decode(F.unhex(F.lpad(F.hex(code(t)), 8, "0")), "UTF-32")), "")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance of two strings of letters() over the longer length; 1 if both are empty, 0 if one is."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)
