"""Readers of publications and writers of reports, on files made here."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.operators import export
from tessella.sinks import files
from tessella.sources import archives
from tessella.sources.tables import view


def _zip(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


EPUB = _zip(**{
    "META-INF__container_dot_xml": '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>',
    "OEBPS__book_dot_opf": '<package><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="c" href="s.css" media-type="text/css"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
    "OEBPS__a_dot_xhtml": "<html><p>first</p></html>", "OEBPS__b_dot_xhtml": "<html><p>second</p></html>", "OEBPS__s_dot_css": "p{}",
})
DOCX = _zip(word__document_dot_xml='<w:document xmlns:w="u"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:body></w:document>')
XLSX = _zip(xl__sharedStrings_dot_xml="<sst><si><t>rule</t></si></sst>", xl__worksheets__sheet1_dot_xml='<worksheet><sheetData><row r="1"><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>')
JATS = b"<article><front><article-title>T</article-title></front><body><sec><title>S</title><p>one  two</p></sec></body><back><ref id='r1'>Ref A</ref></back></article>"
PDF = b"%PDF-1.4\n1 0 obj\nstream\n" + zlib.compress(b"BT (Hello \\(x\\)) Tj [(wor) -20 (ld)] TJ ET") + b"\nendstream\nendobj"


@pytest.fixture
def shelf(tmp_path):
    for name, raw in (("a.epub", EPUB), ("a.docx", DOCX), ("a.xlsx", XLSX), ("a.xml", JATS), ("a.pdf", PDF), ("broken.epub", b"no zip")):
        (tmp_path / name).write_bytes(raw)
    return str(tmp_path)


def test_publications(spark, shelf):
    def rows(kind):
        return [(r["part"], r["kind"], r["content"]) for r in archives.read_parts(spark, shelf, kind).where("error IS NULL").orderBy("path", "ordinal").collect()]

    assert [r[:2] for r in rows("epub")] == [("OEBPS/book.opf", "package"), ("OEBPS/a.xhtml", "spine"), ("OEBPS/b.xhtml", "spine"), ("OEBPS/s.css", "resource")]
    assert rows("docx") == [("p0", "Heading1", "Title"), ("p1", "Normal", "a\tb")]
    assert rows("xlsx") == [("sheet1.xml", "1", "rule\t7")]
    assert rows("jats") == [("article-title", "article-title", "T"), ("S", "paragraph", "one two"), ("r1", "reference", "Ref A")]
    assert rows("pdf") == [("stream0", "text", "Hello (x) world")]
    assert archives.read_parts(spark, shelf, "epub").where("error IS NOT NULL").count() == 1


def test_reports(spark, sf, tmp_path):
    df = spark.createDataFrame([(1, '=1+1, "x"'), (2, None), (3, "plain")], "id long, cell string")
    assert sorted(r[0] for r in files.csv_lines(df, guard=True).collect()) == ["1,\"'=1+1, \"\"x\"\"\"", "2,", "3,plain"]
    files.write_csv(df, str(tmp_path / "c"), guard=True)
    back = spark.read.csv(str(tmp_path / "c"), header=True, quote='"', escape='"')
    assert {(r["id"], r["cell"]) for r in back.collect()} == {("1", "'=1+1, \"x\""), ("2", None), ("3", "plain")}
    files.write_sections({"a": df, "b": df}, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s/b"), header=True).count() == 3
    lines = export.training_lines(view(spark, sf, "zones").where("detector = 'A' AND run_id = 1"), 100.0, 100.0)
    files.write_label_files(lines, str(tmp_path / "y"))
    again = spark.read.option("wholetext", False).text(str(tmp_path / "y/labels"))
    assert again.count() == lines.count() and set(again.columns) >= {"split", "run_id", "page_number"}
    assert "nc: 11" in files.data_sheet(spark, "x").first()[0]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    place = str(tmp_path / "t")
    files.append(df, place)
    new = files.upsert_table(spark, spark.createDataFrame([(2, "B"), (3, "c")], df.schema), place, ["id"], "v2")
    assert sorted(map(tuple, spark.read.parquet(new).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    files.replace_partitions(df, str(tmp_path / "p"), "v")
    files.replace_partitions(df.where("id = 1").withColumn("id", F.lit(9).cast("long")), str(tmp_path / "p"), "v")
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(2, "b"), (9, "a")]
    files.archive_rows(df, "t", str(tmp_path / "z"))
    assert spark.read.parquet(str(tmp_path / "z")).where("row = '{\"id\":1,\"v\":\"a\"}'").count() == 1
    assert files.snapshot(df, "id", "2024-01-01").first()["snapshot"] == '{"v":"a"}'
    works = spark.createDataFrame([("10.1/X", "Title")], "doi string, title string")
    assert archives.reference_lookup(spark.createDataFrame([("10.1/x",), ("10.2/y",)], "doi string"), works).where("title IS NOT NULL").count() == 1
