"""Names for SQL, the command line, and the driver's three functions."""

import __spark_entry__
from texmill import __main__ as cli
from texmill import udfs


def test_functions_in_sql(spark):
    udfs.register(spark)
    got = spark.sql("select seq, text, display from latex_formulas('a $x$ and $$y$$')").collect()
    assert [tuple(r) for r in got] == [(0, "x", False), (1, "y", True)]
    row = spark.sql("select latexify_md('an α') a, latex_structure_error(r'\\frac{a}') b, latexify_tex(null) c").first()
    assert row.a == r"an $\alpha$" and row.b and row.c is None


def test_command_line(capsys):
    assert cli.main([]) == 0 and "clean_md" in capsys.readouterr().out
    assert cli.main(["no_such_query"]) == 2


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert {"total", "inline", "display"} <= {r.kind for r in rows}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
