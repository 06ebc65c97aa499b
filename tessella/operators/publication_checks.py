"""Checks of publications for a publisher's profile, over the parts that sources.archives.read_parts() gives.

Each check is a count of matches in a part's markup without scripts and comments, all of them in one projection;
checks across parts are anti-joins. Codes may carry a profile's prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Presentational tags, attributes that a body must not carry, landmarks, metadata.
FORBIDDEN_TAGS = ("b", "i", "big", "small", "u", "strike", "s", "center", "font")
LANDMARKS = ("cover", "frontmatter", "toc", "bodymatter")
METADATA = {"CONFORMS": "dcterms:conformsTo", "CERTIFIER": "a11y:certifiedBy", "ACCESS-MODE": "schema:accessMode", "FEATURES": "schema:accessibilityFeature", "HAZARDS": "schema:accessibilityHazard", "SUMMARY": "schema:accessibilitySummary"}
ACRONYM = r"\b([A-Z])([.,] |[.,]|\s)([A-Z])(?:\2([A-Z]))+\2?"
PHRASES = ("all rights reserved", "isbn", "first published")
_Q = "[\"']"


def _attr(tag: str, name: str, value: str) -> str:
    """A tag that has the attribute with that value."""
    return rf"(?i)<{tag}\b[^>]*\s{name}\s*=\s*{_Q}{value}{_Q}[^>]*>"


def _without(tag: str, name: str) -> str:
    """A tag that lacks the attribute."""
    return rf"(?i)<{tag}\b(?![^>]*\s{name}\s*=)[^>]*>"


def _clean(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", ""), r"(?s)<!--.*?-->", "")


def _counts(df: DataFrame, keys: list[str], checks: list[tuple[str, str, Column]], prefix: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(prefix + c).alias("code"), F.lit(s).alias("severity"), n.cast("long").alias("n")) for c, s, n in checks])
    return df.select(*keys, F.explode(F.filter(rows, lambda r: r["n"] > 0)).alias("i")).select(*keys, "i.*")


def check_documents(files: DataFrame, keys: list[str], content: str, prefix: str = "") -> DataFrame:
    """keys, code, severity, n of content documents."""
    h = _clean(F.col(content))
    body = F.regexp_replace(h, r"(?is)<head\b[^>]*>.*?</head>", "")
    text = F.regexp_replace(body, r"<[^>]*>", " ")

    def n(pattern: str, of: Column = h) -> Column:
        return F.regexp_count(of, F.lit(pattern))

    def flag(c: Column) -> Column:
        return F.when(c, 1).otherwise(0)

    tables = F.regexp_extract_all(h, F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))
    bare = F.filter(tables, lambda t: ~t.rlike(r"(?i)<th\b") & ~t.rlike(rf"(?i)^<table\b[^>]*\srole\s*=\s*{_Q}[^\"']*(presentation|none)") & (F.regexp_count(t, F.lit(r"(?i)<td\b")) > 0))
    breaks = F.regexp_extract_all(h, F.lit(rf"(?i)<span\b[^>]*\bepub:type\s*=\s*{_Q}[^\"']*\bpagebreak\b[^>]*>"), F.lit(0))
    torn = F.filter(breaks, lambda b: ~(b.rlike(rf"(?i)\srole\s*=\s*{_Q}[^\"']*doc-pagebreak") & b.rlike(rf"(?i)\saria-label\s*=\s*{_Q}\d+{_Q}")))
    tags = F.regexp_extract_all(text, F.lit(r"#(\w{2,})"), F.lit(1))
    flat = F.filter(tags, lambda t: ~t.rlike(r"^\d+$") & ~(t.rlike("[a-z]") & t.rlike("[A-Z]")))
    title = F.trim(F.regexp_extract(h, r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    html = F.regexp_extract(h, r"(?i)<html\b([^>]*)>", 1)
    checks = [
        ("MARKUP-DEPRECATED-TAG", "moderate", n(rf"(?i)<(?:{'|'.join(FORBIDDEN_TAGS)})(?=[\s/>])", body)),
        ("MARKUP-INLINE-STYLE", "minor", n(rf"(?i)\sstyle\s*=\s*{_Q}[^\"']*{_Q}")),
        ("BODY-HAS-ARIA", "moderate", flag(h.rlike(r"(?i)<body\b[^>]*\s(role|aria-label|aria-labelledby)\s*="))),
        ("TABLE-LAYOUT-WITHOUT-PRESENTATION", "serious", F.size(bare)),
        ("PAGEBREAK-MALFORMED", "moderate", F.size(torn)),
        ("HASHTAG-NOT-CAMEL-CASE", "minor", F.size(F.array_distinct(flat))),
        ("ACRONYM-INSERTED-SEPARATORS", "minor", F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(ACRONYM), F.lit(0))))),
        ("XHTML-LANG-MISSING", "serious", flag(~(html.rlike(rf"(?i)(^|\s)lang\s*=\s*{_Q}[^\"']+{_Q}") & html.rlike(rf"(?i)xml:lang\s*=\s*{_Q}[^\"']+{_Q}")))),
        ("XHTML-TITLE-EMPTY", "serious", flag(title == "")),
        ("IMAGE-DECORATIVE-WITHOUT-ROLE", "moderate", n(rf"(?i)<img\b(?=[^>]*\salt\s*=\s*{_Q}{_Q})(?![^>]*\srole\s*=)[^>]*>")),
        ("LANG-INLINE-NOT-MARKED", "moderate", flag(text.rlike(r"[\x{0370}-\x{03FF}\x{0400}-\x{04FF}\x{0590}-\x{06FF}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]{2,}") & ~body.rlike(r"(?i)<(?!html\b|body\b)[a-z][a-z0-9]*\b[^>]*\s(xml:)?lang\s*="))),
        ("EPUB-TYPE-DUPLICATED", "moderate", F.greatest(F.lit(0), n(r"(?i)\bepub:type\s*=\s*[\"'][^\"']*\bchapter\b") - 1)),
        ("ARIA-CHAPTER-ROLE-MISSING", "moderate", n(rf"(?i)<section\b(?=[^>]*epub:type\s*=\s*{_Q}[^\"']*\b(?:chapter|part|dedication|epigraph|appendix)\b)(?![^>]*\srole\s*=)[^>]*>")),
        ("LONG-DESCRIPTION-INLINE", "minor", n(r"(?i)<(?:div|aside|p)\b[^>]*\b(?:class|id)\s*=\s*[\"'][^\"']*long-?desc")),
        ("MEDIA-WITHOUT-FALLBACK", "serious", n(r"(?is)<(?:audio|video)\b[^>]*>\s*(?:<source\b[^>]*>\s*)*</(?:audio|video)>")),
        ("MEDIA-INLINE-WIDTH", "minor", n(r"(?i)<(?:audio|video|iframe)\b[^>]*\swidth\s*=")),
        ("CONTENT-SIDEBAR-MARKUP", "minor", n(r"(?i)<div\b[^>]*\bclass\s*=\s*[\"'][^\"']*\b(?:sidebar|textbox|floatbox)\b")),
    ]
    return _counts(files, keys, checks, prefix)


def check_package(packages: DataFrame, keys: list[str], content: str, prefix: str = "") -> DataFrame:
    """keys, code, severity, n of package files: required metadata, a cover outside the reading order."""
    p = F.col(content)
    checks = [(f"METADATA-MISSING-{k}", "serious", F.when(p.contains(v), 0).otherwise(1)) for k, v in METADATA.items()]
    cover = p.rlike(r"(?i)<itemref\b(?=[^>]*idref\s*=\s*[\"'][^\"']*cover)(?=[^>]*linear\s*=\s*[\"']no)")
    checks.append(("SPINE-COVER-LINEAR", "minor", F.when(p.rlike(r"(?i)<itemref\b[^>]*idref\s*=\s*[\"'][^\"']*cover") & ~cover, 1).otherwise(0)))
    return _counts(packages, keys, checks, prefix)


def check_navigation(navs: DataFrame, keys: list[str], content: str, prefix: str = "") -> DataFrame:
    """keys, code, severity, n of navigation documents: page list, hidden, four landmarks."""
    h = _clean(F.col(content))
    pages = F.regexp_extract(h, rf"(?i)<nav\b[^>]*epub:type\s*=\s*{_Q}[^\"']*page-list[^>]*>", 0)
    marks = F.regexp_extract(h, rf"(?is)<nav\b[^>]*epub:type\s*=\s*{_Q}[^\"']*landmarks[^>]*>(.*?)</nav>", 1)
    hidden = pages.rlike(rf"(?i)\bhidden\b|class\s*=\s*{_Q}[^\"']*hidden")
    checks = [("NAV-PAGE-LIST-MISSING", "serious", F.when(pages == "", 1).otherwise(0)), ("NAV-PAGE-LIST-VISIBLE", "minor", F.when((pages != "") & ~hidden, 1).otherwise(0))]
    checks += [(f"NAV-LANDMARKS-MISSING-{m.upper()}", "moderate", F.when(marks.rlike(rf"(?i)epub:type\s*=\s*{_Q}[^\"']*\b{m}\b"), 0).otherwise(1)) for m in LANDMARKS]
    return _counts(navs, keys, checks, prefix)


def check_styles(sheets: DataFrame, keys: list[str], content: str, prefix: str = "") -> DataFrame:
    """keys, code, severity, n of style sheets: underscores in class names, fonts on paragraphs, imports after rules."""
    c = F.regexp_replace(F.col(content), r"(?s)/\*.*?\*/", "")
    checks = [
        ("CSS-CLASS-NAME", "minor", F.regexp_count(c, F.lit(r"\.[a-zA-Z][\w-]*_[\w-]*\s*[,{]"))),
        ("CSS-PARAGRAPH-FONT", "moderate", F.regexp_count(c, F.lit(r"(?is)(?:^|[,}\s])p\s*\{[^}]*font-family"))),
        ("CSS-IMPORT-ORDER", "moderate", F.when(c.rlike(r"(?s)\}.*@import"), 1).otherwise(0)),
    ]
    return _counts(sheets, keys, checks, prefix)


def check_copyright(files: DataFrame, keys: list[str], content: str, prefix: str = "") -> DataFrame:
    """keys, code, severity, n: a phrase that a copyright page lacks."""
    text = F.lower(F.regexp_replace(F.regexp_replace(_clean(F.col(content)), r"<[^>]*>", " "), r"\s+", " "))
    return _counts(files, keys, [(f"COPYRIGHT-MISSING-{p.upper().replace(' ', '-')}", "serious", F.when(text.contains(p), 0).otherwise(1)) for p in PHRASES], prefix)


def dangling_notes(files: DataFrame, book: str, part: str, content: str) -> DataFrame:
    """book, part, fragment of note references whose target no part of the book has."""
    h = _clean(F.col(content))
    links = F.regexp_extract_all(h, F.lit(rf"(?i)<a\b(?=[^>]*epub:type\s*=\s*{_Q}[^\"']*\bnoteref\b)[^>]*\shref\s*=\s*{_Q}(?![a-z][a-z0-9+.-]*:)[^\"'#]*#([^\"']+){_Q}"), F.lit(1))
    ids = F.regexp_extract_all(h, F.lit(rf"(?i)\sid\s*=\s*{_Q}([^\"']+){_Q}"), F.lit(1))
    refs = files.select(book, part, F.explode(links).alias("fragment")).distinct()
    return refs.join(files.select(book, F.explode(ids).alias("fragment")).distinct(), [book, "fragment"], "left_anti").select(book, part, "fragment")


def reading_order_issues(spine: DataFrame, book: str, ordinal: str, name: str) -> DataFrame:
    """book, code, name: a cover that isn't first, notes before the end, a copyright page outside the first five."""
    by = Window.partitionBy(book)
    place = F.row_number().over(by.orderBy(ordinal))
    notes = F.lower(name).rlike(r"(^|/)(foot|end)notes?\d*\.x?html?$")
    s = spine.withColumn("_place", place).withColumn("_last", F.max(F.when(~notes, F.col(ordinal))).over(by))
    code = F.when(F.lower(name).rlike(r"(^|[/_-])cover[._-]") & (F.col("_place") > 1), "CONTENT-COVER-NOT-FIRST").when(notes & (F.col(ordinal) < F.col("_last")), "SPINE-FOOTNOTES-NOT-LAST").when(F.lower(name).contains("copyright") & (F.col("_place") > 5), "CONTENT-COPYRIGHT-LATE")
    return s.withColumn("code", code).where("code IS NOT NULL").select(book, "code", name)


def required_pages(parts: DataFrame, book: str, name: str, pages: tuple[str, ...] = ("titlepage", "brandpage", "socials")) -> DataFrame:
    """book, code of pages that a book lacks."""
    have = [F.bool_or(F.lower(name).rlike(rf"(^|/){p}[^/]*\.x?html?$")).alias(p) for p in pages]
    rows = F.array(*[F.when(~F.col(p), F.lit(f"{p.upper()}-MISSING")) for p in pages])
    return parts.groupBy(book).agg(*have).select(book, F.explode(rows).alias("code")).where("code IS NOT NULL")


def check_layout(files: DataFrame, book: str, name: str, size: str, most_bytes: int = 300_000) -> DataFrame:
    """book, name, code: names with blanks or capitals, documents and images outside their folders, parts above a size."""
    n = F.col(name)
    codes = F.array(F.when(n.rlike(r"[\sA-Z]") & ~n.rlike(r"^(META-INF|EPUB|OEBPS)/[^A-Z\s]*$"), "LAYOUT-NAME"), F.when(n.rlike(r"(?i)\.(jpe?g|png|gif|svg)$") & ~n.rlike(r"(?i)/images?/"), "LAYOUT-IMAGE-FOLDER"), F.when((F.col(size) > most_bytes) & n.rlike(r"(?i)\.x?html?$"), "LAYOUT-SIZE"))
    return files.select(book, name, F.explode(codes).alias("code")).where("code IS NOT NULL")


def check_images(images: DataFrame, book: str, prefix: str = "") -> DataFrame:
    """book, name, code of image rows: width, height, dpi, colour_space, format."""
    codes = F.array(
        F.when(F.greatest("width", "height") < 600, "IMAGE-TOO-SMALL"),
        F.when(F.col("width") * F.col("height") > 4_000_000, "IMAGE-TOO-LARGE"),
        F.when(F.col("dpi") < 72, "IMAGE-RESOLUTION"),
        F.when(~F.lower("colour_space").isin("rgb", "srgb", "gray"), "IMAGE-COLOUR-SPACE"),
        F.when(~F.lower("format").isin("jpeg", "png", "svg"), "IMAGE-FORMAT"),
    )
    return images.select(book, "name", F.explode(codes).alias("c")).where("c IS NOT NULL").select(book, "name", F.concat(F.lit(prefix), "c").alias("code"))
