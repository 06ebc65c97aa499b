"""Places in the tree against the standard parser; each check of a publication firing and not firing."""

from html.parser import HTMLParser

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import element_trees as et


class Nesting(HTMLParser):
    """Tags with their chains of parents, by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.seen = [], []

    def handle_starttag(self, tag, attrs):
        self.seen.append((tag, tuple(self.open), tuple(sorted((k, v or "") for k, v in dict(attrs[::-1]).items()))))
        if tag not in et.VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.seen.append((tag, tuple(self.open), tuple(sorted((k, v or "") for k, v in dict(attrs[::-1]).items()))))

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass


def _chains(rows):
    tags = {r[0]: r for r in rows}

    def up(n):
        return () if n == 0 else (*up(tags[n][2]), tags[n][5])

    return [(r[5], up(r[2]), tuple(sorted(r[6]))) for r in rows if r[5] != "#text"]


def test_tree_as_the_standard_parser(spark, sf):
    odd = ['<a B=1 c=\'x>y\' d>t<br/><p>1<p>2</a>z</p><!-- <b> --><IMG alt="a &amp; b"><script>var a="</p><i>"</script><b>', "", "<", "a < b <c", "<![CDATA[<x>]]><y/>", "<ul><li>1<li>2</ul><em></em>"]
    pages = [r[0] for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()]
    for html in odd + pages:
        rows = et.scan(html)
        if "CDATA" not in html:
            p = Nesting()
            p.feed(html)
            assert _chains(rows) == p.seen, html[:200]
        last = {r[0]: r[1] for r in rows}
        for r in rows:  # nested sets: what a node holds are the nodes up to its last one
            assert r[2] == 0 or r[2] < r[0] <= last[r[2]]
            assert r[1] == max([r[0]] + [last[q[0]] for q in rows[r[0] : r[1]]])
    assert sum(r[5] == "#text" for r in et.scan(odd[0])) == 4


def _tree(spark, pages):
    files = spark.createDataFrame([(b, p, c, 1) for b, p, c in pages], "book string, part string, c string, node int")
    return et.elements(files, ["book", "part"], "c"), files.withColumn("n", F.regexp_extract("part", r"\d+", 0).cast("int")).select("book", "part", "n")


def test_edge_rows(spark):
    tree, _ = _tree(spark, [(None, "p", "<p>x</p>"), ("b", None, None), ("c", "q", "x" * 300_000 + "<p " + "y" * 100_000)])
    assert [(r["book"], r["tag"]) for r in tree.where("book IS NULL").orderBy("node").collect()] == [(None, "p"), (None, "#text")]
    assert et.content_markup(tree, "book", "part").count() == 0
    assert et.elements(spark.createDataFrame([], "book string, c string"), ["book"], "c").count() == 0


STEP = '<li class="method_steps">x</li>' * 3
# fmt: off
MARKUP = {
    "MARKUP-SIDEBAR-MAINCONTENT-MISSING": (
        ['<div class="sidebar_wrapper"><p>a</p></div>text<div class="maincontent_wrapper"></div>', '<section><div class="x sidebar_wrapper"></div></section><div class="maincontent_wrapper"/>', '<div class="sidebar_wrapper"></div><div></div>'],
        ['<div class="sidebar_wrapper"><div>a</div></div> <!-- c --> <div class="maincontent_wrapper x"></div>', '<div class="no_sidebar_wrapper"></div>']),
    "MARKUP-TEXTBOX-USES-REAL-HEADER": (
        ['<div class="txt_box1"><div><h2>a</h2></div></div><h1>b</h1>'],
        ['<h1>b</h1><div class="txt_box1"><h2>a</h2></div>', '<div class="txt_box"><p>a</p></div><h1>b</h1>']),
    "MARKUP-FLOATBOX-USES-REAL-HEADER": (['<h1>a</h1><aside class="floatbox_left"><div><h3>b</h3></div></aside>'], ['<aside class="floatbox_right"><p>b</p></aside><h1>c</h1>']),
    "MARKUP-POETRY-WRONG-STRUCTURE": (['<div class="poetry_stanza"><p>a</p></div>'], ['<div class="poetry_stanza"><div>a</div></div><p>b</p>']),
    "MARKUP-SPEECHBUBBLE-WRONG-CLASS": (['<figure class="speech-bubble"></figure>', '<figure class="speechbubble_left"/>'], ['<figure class="speechbubble_r nonspeechbubble"></figure>', '<div class="speech_bubble"></div>']),
    "MARKUP-METHOD-STEPS-NOT-OL": (
        [STEP + "<p>1. a</p> <p>2. b</p><p><b>3</b>. c</p>"],
        [STEP + "<p>1. a</p><p>2. b</p><hr/><p>3. c</p>", "<p>1. a</p><p>2. b</p><p>3. c</p>", STEP + "<p>1. a</p><p>2. b</p><p>c 3.</p><p>4. d</p>"]),
}
# fmt: on


def test_content_markup(spark):
    pages = [(f"{code}/{i}", f"p{k}", f"<html><head><title>h</title></head><body>{c}</body></html>") for k, (code, both) in enumerate(MARKUP.items()) for i, c in enumerate([*both[0], *both[1]])]
    tree, _ = _tree(spark, pages)
    got = {(r["book"], r["code"]) for r in et.content_markup(tree, "book", "part").collect()}
    assert got == {(f"{code}/{i}", code) for code, both in MARKUP.items() for i in range(len(both[0]))}


TITLE = '<body><section epub:type="titlepage" class="titlepage"><h3 class="booktitle">T</h3>{}</section></body>'
LOGO = '<figure class="imprint_logo"><img src="x" alt="{}"/></figure>'


@pytest.fixture(scope="module")
def rules(spark):
    return lambda books, image=False: spark.createDataFrame([(b, "The  Logo", image) for b in books], "book string, logo_alt string, image_only boolean")


def test_title_pages(spark, rules):
    pages = [
        ("good", "1.xhtml", TITLE.format("<img alt='other'/>" + LOGO.format("the logo"))), ("alt", "1.xhtml", TITLE.format(LOGO.format("logo"))), ("noalt", "1.xhtml", TITLE.format('<figure class="imprint_logo"><img/></figure>')),
        ("nologo", "1.xhtml", TITLE.format("<img alt='the logo'/>")), ("plain", "2/title_3.xhtml", "<body>" + LOGO.format("The Logo") + "</body>"), ("plain", "1/subtitle.xhtml", TITLE.format("")[:20]), ("none", "1/untitled.xhtml", "<body/>"), ("free", "1.xhtml", "<p/>"),
        ("pelican", "1.xhtml", '<body class="titlepage" epub:type="frontmatter"><p class="booktitle">x</p>' + LOGO.format("The Logo") + "</body>"),
        ("image", "1.xhtml", '<body epub:type="frontmatter"><figure class="image_full"><img alt="x"/></figure></body>'), ("noimage", "1/title.xhtml", '<body><figure class="image_full"/></body>'), ("badimage", "1/title.xhtml", "<body></body>"),
    ]
    tree, parts = _tree(spark, pages)
    table = rules(["good", "alt", "noalt", "nologo", "plain", "none", "pelican"]).unionByName(rules(["image", "noimage", "badimage"], True))
    got = sorted(map(tuple, et.title_pages(tree, parts, table, "book", "part", "n").collect()))
    assert got == [("alt", "TITLE-PAGE-WRONG-LOGO-ALT"), ("badimage", "TITLE-PAGE-WRONG-STRUCTURE"), ("noalt", "TITLE-PAGE-WRONG-LOGO-ALT"), ("nologo", "TITLE-PAGE-MISSING-IMPRINT-LOGO"), ("none", "TITLE-PAGE-MISSING"), ("plain", "TITLE-PAGE-WRONG-STRUCTURE")]


def test_brand_pages(spark):
    page = '<body id="brand_page" epub:type="{}"><figure class="{}"><img alt="{}"/></figure></body>'
    pages = [("good", "1.xhtml", page.format("frontmatter", "x brand_logo_solo", "LOGO")), ("class", "1.xhtml", page.format("x", "image_full", "logo")), ("alt", "1.xhtml", page.format("frontmatter", "brand_logo_solo", "l")), ("none", "1.xhtml", "<body/>"), ("name", "1/a_brand.xhtml", "<p/>"), ("free", "1.xhtml", "<p/>")]
    pages.append(("good", "0.xhtml", page.format("backmatter", "image_full", "LOGO")))  # the one in the front matter goes first
    tree, parts = _tree(spark, pages)
    rules = spark.createDataFrame([(b, "brand_logo_solo", "Logo") for b in ("good", "class", "alt", "none", "name")], "book string, figure_class string, logo_alt string")
    got = sorted(map(tuple, et.brand_pages(tree, parts, rules, "book", "part", "n").collect()))
    assert got == [("alt", "BRAND-PAGE-WRONG-LOGO-ALT"), ("class", "BRAND-PAGE-WRONG-CLASS"), ("name", "BRAND-PAGE-WRONG-CLASS"), ("name", "BRAND-PAGE-WRONG-LOGO-ALT"), ("none", "BRAND-PAGE-MISSING")]


def test_socials_pages(spark):
    def page(*links, line="Read  on"):
        return '<body epub:type="backmatter">' + "".join(f'<p><a href="https://{x}">me</a></p>' for x in links) + f"<p>sign up at news.example</p><p>{line}</p></body>"

    a, b = "twitter.com/ink", "facebook.com/ink"
    pages = [("good", "1/follow_ink.xhtml", page(a, b)), ("turned", "1.xhtml", page(b, a)), ("wrong", "1.xhtml", page("twitter.com/other", b)), ("lost", "1/follow_ink.xhtml", page(a)), ("line", "1.xhtml", page(a, b, line="?")), ("none", "1.xhtml", page(a, b).replace("backmatter", "bodymatter")), ("free", "1.xhtml", "<p/>"), ("named", "1/our-socials.xhtml", "<p>x</p>")]
    tree, parts = _tree(spark, pages)
    books = ["good", "turned", "wrong", "lost", "line", "none", "named"]
    channels = spark.createDataFrame([(x, i, c, h) for x in books for i, (c, h) in enumerate([("twitter", "Twitter.com/ink"), ("facebook", b), ("newsletter", "news.example")])], "book string, position int, channel string, handle string")
    lines = spark.createDataFrame([(x, "read on") for x in books], "book string, strapline string")
    got = sorted(((r[0], r[1], r[2] or "") for r in et.socials_pages(tree, parts, channels, lines, "book", "part", "n", r"follow_ink\.xhtml$").collect()))
    want = [("line", "SOCIALS-STRAPLINE-MISSING", ""), ("lost", "SOCIALS-CHANNEL-MISSING", "facebook"), ("named", "SOCIALS-STRAPLINE-MISSING", ""), ("turned", "SOCIALS-CHANNEL-ORDER-WRONG", ""), ("wrong", "SOCIALS-HANDLE-WRONG", "twitter")]
    want += [("named", "SOCIALS-CHANNEL-MISSING", c) for c in ("twitter", "facebook", "newsletter")]
    assert got == sorted(want + [("none", "SOCIALS-PAGE-MISSING", "")])


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def _query(spark, sf, name):
    from tessella.plans import QUERIES

    return QUERIES[name](spark, sf)


def test_title_pages_are_scanned_once(spark, sf, rules):
    df = _query(spark, sf, "re6e_title_pages")
    assert _scans(df) == 1
    nested = "<body><section epub:type='titlepage'><h3 class='booktitle'>T</h3>" + LOGO.format("the logo").replace("<img", "<figure class='imprint_logo'></figure><img") + "<img alt='x'/></section></body>"
    outside = "<body><section epub:type='titlepage'><h3 class='booktitle'>T</h3><figure class='imprint_logo'></figure><img alt='the logo'/>" + LOGO.format("y") + "</section></body>"
    tree, parts = _tree(spark, [("nested", "1.xhtml", nested), ("outside", "1.xhtml", outside), ("empty", "1/title.xhtml", "")])
    got = sorted(map(tuple, et.title_pages(tree, parts, rules(["nested", "outside", "empty"]), "book", "part", "n").collect()))
    assert got == [("empty", "TITLE-PAGE-MISSING"), ("outside", "TITLE-PAGE-WRONG-LOGO-ALT")]


def test_pages_share_batches():
    names = ["book", "c"]
    pages = pa.record_batch([pa.array(range(2000)), pa.array(["<p>x</p>", None] * 1000)], names)
    got = list(et.node_batches([pages], 1, ["book"]))
    assert len(got) == 1 and got[0].num_rows == 2000 and got[0].column(0).to_pylist()[:4] == [0, 0, 2, 2]
    wide = pa.record_batch([pa.array(range(9)), pa.array(["<p>" + "x" * et.BATCH_CHARS + "</p>"] * 9)], names)
    assert [b.num_rows for b in et.node_batches([wide], 1, ["book"])] == [2] * 9


def test_brand_pages_are_scanned_once(spark, sf):
    assert _scans(_query(spark, sf, "re6f_brand_pages")) == 1


def test_socials_pages_are_scanned_once(spark, sf):
    assert _scans(_query(spark, sf, "re6g_socials_pages")) == 1
