"""Checks of publications and tagged documents on small cases."""

from tessella.operators import pdf_checks as pdf
from tessella.operators import publication_checks as pub


def _codes(df):
    return {(r[0], r["code"]) for r in df.collect()}


def test_documents(spark):
    bad = """<html><head><title> </title><script>var b='<b>';</script></head><body role="main"><b>x</b><p style="x">N.A.S.A. #lowertag #CamelTag Привет</p>
    <table><tr><td>1</td></tr></table><img alt="" src="a"><span epub:type="pagebreak" id="p"/><video><source src="v"></video><section epub:type="chapter">c</section></body></html>"""
    good = """<html lang="en" xml:lang="en"><head><title>T</title></head><body><p>Fine. #CamelTag</p><table role="presentation"><tr><td>1</td></tr></table>
    <img alt="" role="presentation" src="a"><span epub:type="pagebreak" role="doc-pagebreak" aria-label="12"/></body></html>"""
    got = _codes(pub.check_documents(spark.createDataFrame([("bad", bad), ("good", good)], "path string, content string"), ["path"], "content"))
    want = ("MARKUP-DEPRECATED-TAG", "MARKUP-INLINE-STYLE", "BODY-HAS-ARIA", "TABLE-LAYOUT-WITHOUT-PRESENTATION", "PAGEBREAK-MALFORMED", "HASHTAG-NOT-CAMEL-CASE", "ACRONYM-INSERTED-SEPARATORS", "XHTML-LANG-MISSING", "XHTML-TITLE-EMPTY", "IMAGE-DECORATIVE-WITHOUT-ROLE", "LANG-INLINE-NOT-MARKED", "ARIA-CHAPTER-ROLE-MISSING", "MEDIA-WITHOUT-FALLBACK")
    assert got == {("bad", c) for c in want}


def test_packages_navigation_styles(spark):
    opf = "<package><metadata>" + "".join(pub.METADATA.values()) + '</metadata><spine><itemref idref="cover" linear="no"/></spine></package>'
    got = _codes(pub.check_package(spark.createDataFrame([("a", opf), ("b", '<spine><itemref idref="cover"/></spine>')], "p string, c string"), ["p"], "c"))
    assert got == {("b", f"METADATA-MISSING-{k}") for k in pub.METADATA} | {("b", "SPINE-COVER-LINEAR")}
    nav = '<nav epub:type="page-list" hidden="hidden"></nav><nav epub:type="landmarks">' + "".join(f'<a epub:type="{m}"/>' for m in pub.LANDMARKS) + "</nav>"
    got = _codes(pub.check_navigation(spark.createDataFrame([("a", nav), ("b", "<nav/>")], "p string, c string"), ["p"], "c", "X-"))
    assert got == {("b", "X-NAV-PAGE-LIST-MISSING")} | {("b", f"X-NAV-LANDMARKS-MISSING-{m.upper()}") for m in pub.LANDMARKS}
    got = _codes(pub.check_styles(spark.createDataFrame([("a", ".a_b{} p{font-family:x} @import 'y';"), ("b", "@import 'y'; .a-b{}")], "p string, c string"), ["p"], "c"))
    assert got == {("a", "CSS-CLASS-NAME"), ("a", "CSS-PARAGRAPH-FONT"), ("a", "CSS-IMPORT-ORDER")}
    assert _codes(pub.check_copyright(spark.createDataFrame([("a", "<p>All rights  reserved. ISBN 1</p>")], "p string, c string"), ["p"], "c")) == {("a", "COPYRIGHT-MISSING-FIRST-PUBLISHED")}


def test_across_parts(spark):
    parts = spark.createDataFrame([("k", "a", '<a epub:type="noteref" href="n.xhtml#f1">1</a><a epub:type="noteref" href="#f9">2</a>'), ("k", "n", '<aside id="f1"/>'), ("m", "n", '<aside id="f9"/>')], "book string, part string, c string")
    assert [tuple(r) for r in pub.dangling_notes(parts, "book", "part", "c").collect()] == [("k", "a", "f9")]
    spine = spark.createDataFrame([("k", 1, "x/a.xhtml"), ("k", 2, "x/cover.xhtml"), ("k", 3, "x/footnotes.xhtml"), ("k", 4, "x/b.xhtml"), ("m", 1, "cover.xhtml"), ("m", 2, "footnotes.xhtml")], "book string, n int, name string")
    from pyspark.sql import functions as F

    assert {(r["book"], r["code"]) for r in pub.reading_order_issues(spine, "book", "n", F.col("name").alias("name")).collect()} == {("k", "CONTENT-COVER-NOT-FIRST"), ("k", "SPINE-FOOTNOTES-NOT-LAST")}
    assert _codes(pub.required_pages(spine.withColumn("name", F.concat(F.lit("x/titlepage"), "n", F.lit(".xhtml"))), "book", "name", ("titlepage", "socials"))) == {("k", "SOCIALS-MISSING"), ("m", "SOCIALS-MISSING")}
    files = spark.createDataFrame([("k", "EPUB/My File.xhtml", 10), ("k", "EPUB/a.xhtml", 999_999), ("k", "EPUB/pic.png", 5), ("k", "EPUB/images/pic.png", 5)], "book string, name string, size long")
    assert {(r["name"], r["code"]) for r in pub.check_layout(files, "book", "name", "size").collect()} == {("EPUB/My File.xhtml", "LAYOUT-NAME"), ("EPUB/a.xhtml", "LAYOUT-SIZE"), ("EPUB/pic.png", "LAYOUT-IMAGE-FOLDER")}
    images = spark.createDataFrame([("k", "a", 100, 100, 300, "RGB", "jpeg"), ("k", "b", 1000, 1000, 50, "CMYK", "bmp")], "book string, name string, width int, height int, dpi int, colour_space string, format string")
    assert {(r["name"], r["code"]) for r in pub.check_images(images, "book").collect()} == {("a", "IMAGE-TOO-SMALL"), ("b", "IMAGE-RESOLUTION"), ("b", "IMAGE-COLOUR-SPACE"), ("b", "IMAGE-FORMAT")}


def test_tagged_documents(spark):
    e = spark.createDataFrame([(1, "figure", None, None, None, None, None), (2, "figure", "image of x", None, None, None, None), (3, "figure", "a.png", None, None, None, None), (4, "formula", None, None, None, None, None), (5, "link", None, None, "Click here", None, None), (6, "field", None, None, "", " ", None), (7, "bookmark", None, None, "Untitled 3", None, None), (8, "list-item", None, None, "x", None, "p"), (9, "figure", "A red fox", None, None, None, None), (10, "list-item", None, None, "x", None, "list")], "id long, kind string, alt string, actual_text string, text string, tooltip string, parent_kind string")
    got = _codes(pdf.check_elements(e, ["id"]))
    assert got == {(1, "13-004"), (2, "ALT-TEXT-REDUNDANT-PREFIX"), (3, "ALT-TEXT-QUALITY"), (4, "FORMULA-MISSING-ACTUALTEXT"), (5, "LINK-GENERIC-TEXT"), (6, "FORM-FIELD-NO-LABEL"), (6, "FORM-FIELD-MISSING-TOOLTIP"), (7, "BOOKMARK-GENERIC-TEXT"), (8, "LIST-IMPROPER-MARKUP")}
    runs = spark.createDataFrame([(1, "#777777", "#ffffff", 12.0, False), (2, "#777777", "#ffffff", 18.0, False), (3, "#000000", "#ffffff", 8.0, False)], "id long, fg string, bg string, size double, bold boolean")
    assert [r["id"] for r in pdf.check_contrast(runs, ["id"]).collect()] == [1]
