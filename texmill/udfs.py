"""The package's functions under names for SQL: register(spark) makes them known to a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from texmill.functions import formulas, readings
from texmill.functions import unicode_math as um
from texmill.storage import reachable


@udtf(returnType="seq int, text string, display boolean")
class LatexFormulas:
    """Formulas of a LaTeX source in order, its own macros expanded."""

    def eval(self, text: str) -> Iterator[tuple[int, str, bool]]:
        for seq, (formula, display) in enumerate(formulas.of_source(text or "")):
            yield seq, formula, display


def register(spark: SparkSession) -> None:
    """latex_formulas (table function), latex_structure_error, latexify_md, latexify_tex, latex_macros_expanded, reading_cleaned."""
    reachable(spark)
    spark.udtf.register("latex_formulas", LatexFormulas)
    for name, f in {
        "latex_structure_error": readings.structure_error,
        "latexify_md": um.latexify_markdown,
        "latexify_tex": um.latexify_tex,
        "latex_macros_expanded": lambda t: formulas.expanded(t, formulas.macros(t)),
        "reading_cleaned": lambda t: readings.cleaned(readings.joined(t)),
    }.items():
        spark.udf.register(name, lambda t, f=f: f(t) if t is not None else None, "string")
