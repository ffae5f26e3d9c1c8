"""Unicode translation, readings, sources and streaming."""

import io
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from texmill.functions import latex, markdown
from texmill.functions import readings as rd
from texmill.functions import unicode_math as um
from texmill.sources import texts as src
from texmill.streaming import edits


@pytest.mark.parametrize(
    ("md", "want"),
    [
        ("if α ≤ β then x² ∈ ℝ.", r"if $\alpha \leq \beta$ then $x^{2} \in \mathbb{R}$."),
        ("the — dash", "the --- dash"),
        ("`code α` [α](u)", "`code α` [α](u)"),
        ("𝐱 and 𝛼.", r"$\mathbf{x}$ and $\alpha$."),
        ("√(a+b) ≥ 0 holds", r"$\sqrt{a+b} \geq 0$ holds"),
        ("", ""),
    ],
)
def test_markdown(md, want):
    assert um.latexify_markdown(md) == want


@pytest.mark.parametrize(
    ("tex", "want"),
    [
        ("γ ≤ 5", r"$\gamma \leq 5$"),
        ("% α\nβ", "% α\n$\\beta$"),
        (r"$x≤y^{a}^{b}$", r"$x\leq y^{ab}$"),
        (r"\sigma x", r"$\sigma$ x"),
        ("é stays", "é stays"),
        (r"\verb|x| \cite{α}", r"\verb|x| \cite{α}"),
    ],
)
def test_tex(tex, want):
    assert um.latexify_tex(tex) == want


def test_parts():
    assert um.balanced("{a}} {b") == r"{a}\} \{b"
    assert um.merged_scripts("x_{1}^{s}_{,b} S^{z}'") == r"x_{1,b}^{s} S^{z\prime}"
    assert um.inside("x⃗ ≠") == r"\vec{x} \not ="
    assert um.repaired(chr(0xD465)) == chr(0x1D465) and um.repaired(chr(0xD465) + "가") == chr(0xD465) + "가"


GOOD = [r"\frac{a}{b}", r"x_{1}^{2}", r"\left( \frac{1}{2} \middle| y \right)", r"\begin{pmatrix} a & b \\ c & d \end{pmatrix}", r"\text{if } x", r"\sqrt[3]{x}", r"\operatorname*{argmax}_x f", "f'", r"\big( x \big)", r"\begin{array}{cc} a & b \end{array}"]
BAD = [r"\frac{a}", "x^2^3", r"\left( x", r"x \right)", "{x", "x}", "a & b", r"\begin{foo} x \end{foo}", r"\begin{array} a \end{array}", r"\nosuch x", "x^", "100%", r"\text{a^b}", r"\left x \right)", r"\begin{matrix} a", "x^{2}'", r"\middle| x", r"\sqrt[3{x}"]


@pytest.mark.parametrize("formula", GOOD)
def test_sound(formula):
    assert rd.structure_error(formula) is None


@pytest.mark.parametrize("formula", BAD)
def test_broken(formula):
    assert rd.structure_error(formula)


def test_readings():
    assert rd.joined(r"\operatorname* { l i m } _ { T \to \infty } x") == r"\lim_{T\to\infty}x"
    assert rd.cleaned(r"\[ {\frac{a}{b}} \quad . \]") == r"\frac{a}{b}"
    assert rd.cleaned(r"\left. f \right|_0") == r"\left. f \right|_0"
    assert not rd.usable("") and not rd.usable("abcd" * 6) and rd.usable("x+1")


def test_decoding(spark):
    blobs = [("a", "é\r\nx".encode()), ("b", b"\xef\xbb\xbfx"), ("c", "é €".encode("cp1252")), ("d", b"\x81\xe9\rz"), ("e", b""), ("f", r"\usepackage[latin1]{inputenc} é".encode("latin-1"))]
    got = {r.path: (r.text, r.encoding, r.newline) for r in src.decoded(spark.createDataFrame(blobs, "path string, content binary")).collect()}
    assert got["a"] == ("é\nx", "utf-8", "crlf") and got["b"] == ("x", "utf-8-sig", "lf") and got["c"][:2] == ("é €", "cp1252")
    assert got["d"][1:] == ("latin-1", "cr") and got["e"] == ("", "utf-8", "lf") and got["f"][1] == "latin-1"


@pytest.mark.parametrize("charset", ["utf-8", "utf-8-sig", "cp1252", "iso8859-15", "latin-1"])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_bytes_come_back(spark, charset, end):
    said = {"cp1252": r"\usepackage[cp1252]{inputenc}", "iso8859-15": r"\usepackage[latin9]{inputenc}", "latin-1": r"\usepackage[latin1]{inputenc}"}.get(charset, "")
    data = f"{said}{end}é ÿ{end}{'€ š' if charset in ('cp1252', 'iso8859-15', 'utf-8') else ''}{end}".encode(charset)
    (row,) = src.decoded(spark.createDataFrame([("a", data)], "path string, content binary")).select("encoding", src.encoded(F.col("text"), F.col("encoding"), F.col("newline")).alias("data")).collect()
    assert bytes(row.data) == data and row.encoding == charset


def test_bytes_that_do_not_fit(spark):
    with pytest.raises(PySparkException):
        spark.createDataFrame([("a 日",)], "t string").select(src.encoded(F.col("t"), F.lit("cp1252"), F.lit("lf"))).collect()


def test_names_that_are_there_already(spark):
    paths = ["a.tex", "a.tex", "a_1.tex", "a.tex", "a_3.tex", "b", "b", "b_1", "b_1", "c_x.tex", "c_x.tex"]
    got = {r.pos: r.name for r in src.unique_names(spark.createDataFrame(list(enumerate(paths)), "pos int, path string").select("path", "pos")).collect()}
    assert [got[i] for i in range(len(paths))] == ["a.tex", "a_2.tex", "a_1.tex", "a_4.tex", "a_3.tex", "b", "b_2", "b_1", "b_1_1", "c_x.tex", "c_x_1.tex"]


def test_byte_letters():
    assert rd.decoded_bytes("ĠxÃ©") == " xé" and rd.decoded_bytes("") == ""


def test_docx(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", "<m:oMath>x</m:oMath>")
        z.writestr("word/media/a.png", "")
    got = {r.path: (r.document_xml, r.media) for r in src.docx_parts(spark.createDataFrame([("a", data.getvalue()), ("b", b"no")], "path string, content binary")).collect()}
    assert got == {"a": ("<m:oMath>x</m:oMath>", ["word/media/a.png"]), "b": (None, [])}


def test_report_keeps_other_modes(spark, tmp_path):
    path = str(tmp_path / "report")
    one = spark.createDataFrame([("plain", "total", 1.0), ("model", "total", 2.0)], "mode string, kind string, exact_pct double")
    src.write_report(one, path)
    src.write_report(one.filter("mode = 'plain'").withColumn("exact_pct", F.lit(9.0)), path)
    assert {r.mode: r.exact_pct for r in spark.read.json(path).collect()} == {"plain": 9.0, "model": 2.0}


@pytest.mark.parametrize("spec", ["x-3", "1-2-3", "0"])
def test_bad_page_selection(spark, spec):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(spec,)], "s string").select(markdown.pages(F.col("s"))).collect()


def test_page_selection_of_nothing(spark):
    assert [r[0] for r in spark.createDataFrame([("",), (None,), ("3-1,2",)], "s string").select(markdown.pages(F.col("s"))).collect()] == [None, None, [0, 1, 2]]


def test_bibliography(spark):
    got = spark.createDataFrame([(r"\bibliography{a, b.bib ,} \addbibresource{old.v1}",)], "t string").select(latex.bibliography(F.col("t")).alias("b"))
    assert got.first().b == ["a.bib", "b.bib", "old.bib"]


def test_stream_sessions_and_state(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "a", False, 1.0), (1, "2024-01-01 00:00:02", "b", False, 2.0), (1, "2024-01-01 00:01:00", "c", True, 3.0), (2, "2024-01-01 00:00:05", "d", False, 4.0), (3, "2024-01-01 05:00:00", "e", False, 5.0)]
    df = spark.createDataFrame(rows, "doc_id long, ts string, text string, saved boolean, edited double").withColumn("ts", F.to_timestamp("ts"))
    folder = str(tmp_path / "in")
    df.coalesce(1).write.parquet(folder)
    stream = edits.read(spark, folder, df.schema)
    found = edits.sessions(stream, "doc_id", "10 seconds", "1 minute")
    q = found.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.doc_id, r.n) for r in spark.table("sessions").collect()) == [(1, 1), (1, 2), (2, 1)]  # the last is still open
    q = edits.unsaved(stream.select("doc_id", "text", "saved", "edited")).writeStream.format("memory").queryName("unsaved").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.doc_id: r.text for r in spark.table("unsaved").collect()} == {1: None, 2: "d", 3: "e"}
    assert [r.doc_id for r in edits.unsaved_now(df.select("doc_id", "text", "saved", "edited")).orderBy("edited").collect()] == [2, 3]
    seen = []
    edits.coalesced(stream, lambda b: seen.extend(r.doc_id for r in b.collect()), str(tmp_path / "c3"))
    assert sorted(seen) == [1, 2, 3]
