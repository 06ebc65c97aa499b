"""Markup as rows: one scan a page gives every element its place in the tree, checks are joins over those places.

Nodes are numbered in the order in which they open; an element holds the nodes from its own number to `last`. So "inside"
is a join on the page with a condition on two numbers, "next" is a place among the children of one parent, and "first" is
the smallest number.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements without an end, elements whose content is no markup, classes and prefixes that the profile names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
SPEECH_BUBBLES = ("speechbubble", "speechbubble_r", "speechbubble_bl", "speechbubble_br")
CHANNELS = {"twitter": "twitter.com/", "facebook": "facebook.com/", "instagram": "instagram.com/", "youtube": "youtube.com/", "pinterest": "pinterest.com/", "linkedin": "linkedin.com/", "tiktok": "tiktok.com/", "newsletter": ""}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements of a method list that make a book one of recipes, and numbered paragraphs in a row that should be such a list.
RECIPE_MARKS, NUMBERED_RUN = 3, 3
#: Nodes and characters of pages that one Arrow batch holds, about: a batch a page costs more than its scan.
BATCH_NODES, BATCH_CHARS = 1 << 14, 1 << 22

_TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][\w:.-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_FIELDS = [("node", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("place", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("closed", pa.bool_())]


def scan(html: str) -> list[list]:
    """The nodes of a page, in order: node, last, parent, place, depth, tag, attrs, text, closed.

    Nodes count from 1, the parent of what stands outside all elements is 0, places among siblings count from 0. Text that
    isn't blank is a node of tag `#text`. An end without a beginning is skipped; one that leaves inner elements open ends
    them too, and they are not closed. Comments, declarations, scripts and styles hold no nodes.
    """
    out: list[list] = []
    open_, children = [0], [0]
    at, bound = 0, html.rfind(">") + 1

    def add(tag: str, attrs: list, text: str | None) -> None:
        out.append([len(out) + 1, len(out) + 1, open_[-1], children[-1], len(open_), tag, attrs, text, True])
        children[-1] += 1

    def words(to: int) -> None:
        piece = html[at:to]
        if piece and not piece.isspace():
            add("#text", [], unescape(piece))

    while True:
        m = _TOKEN.search(html, at, bound)
        words(m.start() if m else len(html))
        if m is None:
            break
        at = m.end()
        if m[1] is not None and not m[1].isspace() and m[1]:
            add("#text", [], m[1])
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            k = next((k for k in range(len(open_) - 1, 0, -1) if out[open_[k] - 1][5] == tag), 0)
            for inner in open_[k + 1 :] if k else ():
                out[inner - 1][1], out[inner - 1][8] = len(out), False
            if k:
                out[open_[k] - 1][1] = len(out)
                del open_[k:], children[k:]
            continue
        attrs = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in reversed([*_ATTR.finditer(m[4])])}
        add(tag, list(attrs.items()), None)
        if tag in VOID or m[4].rstrip().endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at, out[-1][8] = (end.end(), True) if end else (len(html), False)
            continue
        open_.append(len(out))
        children.append(0)
    for k in open_[1:]:
        out[k - 1][1], out[k - 1][8] = len(out), False
    return out


def node_batches(batches: Iterable[pa.RecordBatch], n_keys: int, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The nodes of pages, with their keys; many small pages share a batch. batches: keys, then the page's markup."""
    names = [*keys, *[n for n, _ in _FIELDS]]

    def rows(batch: pa.RecordBatch, at: list[int], found: list[list]) -> pa.RecordBatch:
        of = pa.array(at, pa.int64())
        return pa.record_batch([*[batch.column(k).take(of) for k in range(n_keys)], *[pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True), _FIELDS, strict=True)]], names)

    for batch in batches:
        at, found, chars = [], [], 0
        for i, html in enumerate(batch.column(n_keys).to_pylist()):
            nodes = scan(html or "")
            at += [i] * len(nodes)
            found += nodes
            chars += len(html or "")
            if found and (len(found) >= BATCH_NODES or chars >= BATCH_CHARS):
                yield rows(batch, at, found)
                at, found, chars = [], [], 0
        if found:
            yield rows(batch, at, found)


def elements(files: DataFrame, keys: list[str], content: str) -> DataFrame:
    """keys and the columns of scan() for every node of every page, with classes and types (of epub:type) as arrays.

    A null page has no nodes; repeated pages of one key give repeated nodes, so keys should name a page.
    """
    fields = ", ".join([f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys] + ["node int, last int, parent int, place int, depth int, tag string, attrs map<string,string>, text string, closed boolean"])
    def tokens(name: str) -> Column:
        return F.filter(F.split(F.coalesce(F.col("attrs")[name], F.lit("")), r"\s+"), lambda x: x != "")

    found = files.select(*keys, content).mapInArrow(lambda batches: node_batches(batches, len(keys), keys), fields)
    return found.withColumn("classes", tokens("class")).withColumn("types", tokens("epub:type"))


def inside(tree: DataFrame, keys: list[str], outer: Column, inner: Column) -> DataFrame:
    """keys, outer, node, and all else of the inner nodes: pairs of an element and what it holds."""
    a = tree.where(outer).where("closed").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("node").alias("outer"), F.col("last").alias("_last"))
    same = [F.col(f"_{k}").eqNullSafe(tree[k]) for k in keys]
    held = tree.where(inner).join(a, [*same, tree["node"] > a["outer"], tree["node"] <= a["_last"]])
    return held.drop("_last", *[f"_{k}" for k in keys])


def _has(c: str) -> Column:
    return F.array_contains("classes", c)


def _heading() -> Column:
    return F.col("tag").isin(*HEADINGS)


def content_markup(tree: DataFrame, book: str, part: str) -> DataFrame:
    """book, part, code: sidebars, boxes, stanzas, speech bubbles and method lists that aren't marked up as the profile has it.

    A sidebar's wrapper is followed at once by that of the main content; the first heading of a part stands in no text box,
    none in a floating box; lines of a stanza are no paragraphs; speech bubbles are figures of four classes; in a book of
    recipes three numbered paragraphs in a row should be a list.
    """
    keys = [book, part]
    tree = tree.where(~(F.col("tag") == "head"))
    follower = tree.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("parent").alias("_parent"), (F.col("place") - 1).alias("_place"), _has("maincontent_wrapper").alias("paired"))
    sides = tree.where(_has("sidebar_wrapper") & F.col("closed"))
    paired = sides.join(follower, [*[F.col(f"_{k}").eqNullSafe(sides[k]) for k in keys], F.col("_parent") == F.col("parent"), F.col("_place") == F.col("place")], "left")
    found = [(paired.where("paired IS NULL OR NOT paired"), "MARKUP-SIDEBAR-MAINCONTENT-MISSING")]
    first = tree.where(_heading()).groupBy(*keys).agg(F.min("node").alias("_first"))
    boxed = inside(tree, keys, F.exists("classes", lambda c: c.startswith("txt_box")), _heading())
    boxed = boxed.join(first.select(*[F.col(k).alias(f"_{k}") for k in keys], "_first"), [*[F.col(f"_{k}").eqNullSafe(boxed[k]) for k in keys], F.col("_first") == F.col("node")])
    found.append((boxed, "MARKUP-TEXTBOX-USES-REAL-HEADER"))
    found.append((inside(tree, keys, _has("floatbox_left") | _has("floatbox_right"), _heading()), "MARKUP-FLOATBOX-USES-REAL-HEADER"))
    found.append((inside(tree, keys, _has("poetry_stanza"), F.col("tag") == "p"), "MARKUP-POETRY-WRONG-STRUCTURE"))
    odd = F.exists("classes", lambda c: c.rlike("(?i)^speech[-_]?bubble") & ~c.isin(*SPEECH_BUBBLES))
    found.append((tree.where((F.col("tag") == "figure") & odd), "MARKUP-SPEECHBUBBLE-WRONG-CLASS"))
    recipes = tree.where(_has("method_steps")).groupBy(F.col(book).alias("_book")).count().where(F.col("count") >= RECIPE_MARKS).select("_book")
    found.append((numbered_paragraphs(tree, keys).join(recipes, F.col("_book").eqNullSafe(F.col(book)), "left_semi"), "MARKUP-METHOD-STEPS-NOT-OL"))
    rows = None
    for df, code in found:
        df = df.select(*keys, F.lit(code).alias("code"))
        rows = df if rows is None else rows.unionByName(df)
    return rows.distinct()


def text_of(tree: DataFrame, keys: list[str], outer: Column) -> DataFrame:
    """keys, outer, content: the text in each such element, pieces joined as they stand; elements without text are left out."""
    pieces = inside(tree, keys, outer, F.col("tag") == "#text").groupBy(*keys, "outer").agg(F.array_sort(F.collect_list(F.struct("node", "text"))).alias("p"))
    return pieces.select(*keys, "outer", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("content"))


def numbered_paragraphs(tree: DataFrame, keys: list[str], least: int = NUMBERED_RUN) -> DataFrame:
    """keys, parent, paragraphs: stretches of `least` or more sibling paragraphs that begin with a number and a stop, nothing between them."""
    is_p = F.col("tag") == "p"
    text = text_of(tree, keys, is_p).where(F.trim("content").rlike(r"^\s*\d+\.")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("outer").alias("_node"))
    ps = tree.where(is_p).join(text, [*[F.col(f"_{k}").eqNullSafe(tree[k]) for k in keys], F.col("_node") == F.col("node")], "left_semi")
    # Places of siblings that follow each other rise as their rank does.
    run = F.col("place") - F.row_number().over(Window.partitionBy(*keys, "parent").orderBy("place"))
    return ps.withColumn("_run", run).groupBy(*keys, "parent", "_run").agg(F.count("*").alias("paragraphs")).where(F.col("paragraphs") >= least).drop("_run")


def _first_way(ways: list[Column]) -> Column:
    """The place of the earliest way that holds, null if none does."""
    return F.coalesce(*[F.when(w, F.lit(i)) for i, w in enumerate(ways)])


def _with_facts(parts: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """parts with the facts of their pages, null where a page has none."""
    facts = facts.withColumnsRenamed({k: f"_{k}" for k in keys})
    return parts.join(facts, [F.col(f"_{k}").eqNullSafe(parts[k]) for k in keys], "left").drop(*[f"_{k}" for k in keys])


def _pick(way: Column, ordinal: str, part: str, facts: list[str]) -> Column:
    """Of a book's parts the one that the earliest way finds, of several the first, with its facts; an aggregate, null if none."""
    return F.min(F.when(way.isNotNull(), F.struct(way.alias("_way"), F.col(ordinal).alias("_at"), F.col(part).alias("_name"), *facts)))


def _same_alt(seen: Column, wanted: Column) -> Column:
    def norm(c: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))

    return norm(seen).eqNullSafe(norm(wanted))


def title_pages(tree: DataFrame, parts: DataFrame, rules: DataFrame, book: str, part: str, ordinal: str) -> DataFrame:
    """book, code of title pages. parts: every part of a book with its ordinal; rules: book, logo_alt, image_only (an image is the whole page).

    Books without a rule have no title page to look for. A page is a section of that type, else a front matter body of that
    class, else one of a telling name; it holds a book title and, as a figure, the imprint's logo with its alternative text.
    The tree is read once: what tells a page is brought to one row a page, and of these each book's page is chosen.
    """
    keys = [book, part]
    body, front = F.col("tag") == "body", F.array_contains("types", "frontmatter")
    section = (F.col("tag") == "section") & F.array_contains("types", "titlepage")
    full = (F.col("tag") == "figure") & _has("image_full")
    logo = (F.col("tag") == "figure") & _has("imprint_logo") & F.col("closed")
    image = (F.col("tag") == "img") & F.col("attrs")["alt"].isNotNull()
    nodes = tree.select(*keys, "node", "last", section.alias("section"), (body & front).alias("front"), (body & front & _has("titlepage")).alias("marked"), _has("booktitle").alias("titled"), logo.alias("logo"), full.alias("full"), F.when(image, F.struct("node", F.col("attrs")["alt"].alias("alt"))).alias("image"))
    told = nodes.where("node = 1 OR section OR front OR titled OR logo OR full OR image IS NOT NULL")  # a page's first node stands for its being there
    # From the end on, the last image seen is the next one after a node; a logo holds it if it stands before the logo's end.
    after = F.last("image", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, -1))
    held = F.when(F.col("logo") & (F.col("_next")["node"] <= F.col("last")), F.struct("node", F.col("_next")["alt"].alias("alt")))
    any_ = {c: F.bool_or(c).alias(c) for c in ("section", "front", "marked", "titled", "logo", "full")}
    facts = told.withColumn("_next", after).groupBy(*keys).agg(*any_.values(), F.min(held)["alt"].alias("alt"))
    name = F.col(part).rlike(r"(?i)(^|/)(title([_-]\d+)?|[a-z]+_titlepage)\.x?html?$")
    kept = ["titled", "logo", "full", "alt"]
    books = _with_facts(parts, facts, keys).groupBy(book).agg(
        _pick(_first_way([F.col("section"), F.col("marked"), name]), ordinal, part, kept).alias("_of_text"),
        _pick(_first_way([F.col("front") & F.col("full"), name]), ordinal, part, kept).alias("_of_image"),
    )
    rules = rules.select(F.col(book).alias("_rb"), "logo_alt", "image_only")
    page = F.when(F.col("image_only"), F.col("_of_image")).otherwise(F.col("_of_text"))
    each = books.join(rules, F.col("_rb").eqNullSafe(books[book])).select(book, "logo_alt", "image_only", page.alias("page")).select(book, "logo_alt", "image_only", *[F.col("page")[c].alias(c) for c in kept])
    there = F.col("titled").isNotNull()
    codes = F.array(
        F.when(~there, "TITLE-PAGE-MISSING"),
        F.when(there & F.when(F.col("image_only"), ~F.col("full")).otherwise(~F.col("titled")), "TITLE-PAGE-WRONG-STRUCTURE"),
        F.when(there & ~F.col("image_only") & ~F.col("logo"), "TITLE-PAGE-MISSING-IMPRINT-LOGO"),
        F.when(there & ~F.col("image_only") & F.col("logo") & ~(F.col("alt").isNotNull() & _same_alt(F.col("alt"), F.col("logo_alt"))), "TITLE-PAGE-WRONG-LOGO-ALT"),
    )
    return each.select(book, F.explode(F.array_compact(codes)).alias("code"))


def brand_pages(tree: DataFrame, parts: DataFrame, rules: DataFrame, book: str, part: str, ordinal: str) -> DataFrame:
    """book, code of brand pages; rules: book, figure_class, logo_alt. Books without a rule need none.

    A page is a body of the id brand_page, in the front matter if there is one, else one of a telling name. Its first figure
    with a class has the class, its first image with an alternative text the text that the imprint wants. The tree is read
    once, as for title pages.
    """
    keys = [book, part]
    marked = (F.col("tag") == "body") & (F.lower(F.col("attrs")["id"]) == "brand_page")
    figure = F.when((F.col("tag") == "figure") & (F.size("classes") > 0), F.struct("node", "classes"))
    image = F.when((F.col("tag") == "img") & F.col("attrs")["alt"].isNotNull(), F.struct("node", F.col("attrs")["alt"].alias("alt")))
    nodes = tree.select(*keys, "node", F.coalesce(marked & F.array_contains("types", "frontmatter"), F.lit(False)).alias("front"), F.coalesce(marked, F.lit(False)).alias("marked"), figure.alias("figure"), image.alias("image"))
    told = nodes.where("node = 1 OR marked OR figure IS NOT NULL OR image IS NOT NULL")
    facts = told.groupBy(*keys).agg(F.bool_or("front").alias("front"), F.bool_or("marked").alias("marked"), F.min("figure")["classes"].alias("classes"), F.min("image")["alt"].alias("alt"), F.lit(True).alias("there"))
    name = F.col(part).rlike(r"(?i)(^|/)(brand[-_ ]?page|[\w-]+[-_]brand|brand)\.x?html?$")
    kept = ["classes", "alt", "there"]
    books = _with_facts(parts, facts, keys).groupBy(book).agg(_pick(_first_way([F.col("front"), F.col("marked"), name]), ordinal, part, kept).alias("page"))
    rules = rules.select(F.col(book).alias("_rb"), "figure_class", "logo_alt")
    each = books.join(rules, F.col("_rb").eqNullSafe(books[book])).select(book, "figure_class", "logo_alt", *[F.col("page")[c].alias(c) for c in kept])
    there = F.col("there").isNotNull()
    known = F.coalesce(F.get(F.filter("classes", lambda c: c.isin("brand_logo_solo", "image_full")), F.lit(0)), F.get("classes", F.lit(0)))
    codes = F.array(
        F.when(~there, "BRAND-PAGE-MISSING"),
        F.when(there & ~known.eqNullSafe(F.col("figure_class")), "BRAND-PAGE-WRONG-CLASS"),
        F.when(there & ~(F.col("alt").isNotNull() & _same_alt(F.col("alt"), F.col("logo_alt"))), "BRAND-PAGE-WRONG-LOGO-ALT"),
    )
    return each.select(book, F.explode(F.array_compact(codes)).alias("code"))


def flowing_text(tree: DataFrame, keys: list[str], *facts: Column) -> DataFrame:
    """keys, content: a page's text in lower case with the targets of links where they stand, blanks as one; facts: further aggregates of its nodes."""
    piece = F.when(F.col("tag") == "#text", F.col("text")).when(F.col("tag") == "a", F.col("attrs")["href"])
    pieces = F.collect_list(F.when(piece.isNotNull(), F.struct("node", piece.alias("piece"))))
    pages = tree.groupBy(*keys).agg(pieces.alias("_pieces"), *facts).where(F.size("_pieces") > 0)
    text = F.array_join(F.transform(F.array_sort("_pieces"), lambda x: x["piece"]), " ")
    return pages.withColumn("content", F.lower(F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " ")))).drop("_pieces")


def socials_pages(tree: DataFrame, parts: DataFrame, channels: DataFrame, straplines: DataFrame, book: str, part: str, ordinal: str, hint: str) -> DataFrame:
    """book, code, channel of pages that list where an imprint is found.

    channels: book, position, channel (of CHANNELS), handle, in the order in which they should stand; straplines: book,
    strapline; hint: a pattern for the name of such a page. A page is back matter with that name, else back matter that names
    two channels, else one of a telling name. Channels are looked for by handle; one named by its address alone has a wrong
    handle. channel is null for codes of a whole page. Books without channels need no page.
    """
    keys = [book, part]
    absent = F.lit(None).cast("string")
    need = parts.join(channels.select(F.col(book).alias("_cb")).distinct(), F.col("_cb").eqNullSafe(parts[book]), "left_semi")
    back = (F.col("tag") == "body") & F.array_contains("types", "backmatter")
    text = flowing_text(tree, keys, F.bool_or(back).alias("back"))
    named = sum([F.col("content").contains(p).cast("int") for p in CHANNELS.values() if p], F.lit(0))
    name = F.col(part).rlike(r"(?i)(^|/)(follow[_-][\w-]+|[\w-]*socials[\w-]*)\.x?html?$")
    way = _first_way([F.col("back") & F.col(part).rlike(hint), F.col("back") & (named >= 2), name])
    page = _with_facts(need, text, keys).groupBy(book).agg(_pick(way, ordinal, part, ["content"]).alias("page")).select(book, F.col("page").isNotNull().alias("there"), F.coalesce(F.col("page")["content"], F.lit("")).alias("content"))
    rules = channels.groupBy(F.col(book).alias("_cb")).agg(F.array_sort(F.collect_list(F.struct("position", "channel", F.lower("handle").alias("handle")))).alias("rules"))
    lines = straplines.groupBy(F.col(book).alias("_sb")).agg(F.collect_list(F.lower(F.trim(F.regexp_replace("strapline", r"\s+", " ")))).alias("lines"))
    each = page.join(rules, F.col("_cb").eqNullSafe(page[book])).join(lines, F.col("_sb").eqNullSafe(page[book]), "left")
    prefix = F.create_map(*[F.lit(x) for kv in CHANNELS.items() for x in kv])

    def seen(r: Column) -> Column:
        address = prefix[r["channel"]]
        return F.struct(F.position(r["handle"], F.col("content")).alias("at"), ((F.length(address) > 0) & F.contains(F.col("content"), address)).alias("named"), r["channel"].alias("channel"))

    each = each.withColumn("seen", F.transform("rules", seen)).withColumn("at", F.transform(F.filter("seen", lambda s: s["at"] > 0), lambda s: s["at"]))
    lost = F.transform(F.filter("seen", lambda s: s["at"] == 0), lambda s: F.struct(F.when(s["named"], "SOCIALS-HANDLE-WRONG").otherwise("SOCIALS-CHANNEL-MISSING").alias("code"), s["channel"].alias("channel")))
    turned = F.exists(F.arrays_zip(F.col("at").alias("a"), F.slice("at", F.lit(2), F.greatest(F.size("at") - 1, F.lit(0))).alias("b")), lambda x: x["b"] <= x["a"])
    bare = F.transform(F.filter("lines", lambda x: ~F.contains(F.col("content"), x)), lambda _: F.struct(F.lit("SOCIALS-STRAPLINE-MISSING").alias("code"), absent.alias("channel")))

    def one(code: str, when: Column) -> Column:
        return F.when(when, F.array(F.struct(F.lit(code).alias("code"), absent.alias("channel"))))

    none = F.array().cast("array<struct<code:string,channel:string>>")
    on_page = F.concat(lost, F.coalesce(one("SOCIALS-CHANNEL-ORDER-WRONG", turned), none), F.coalesce(bare, none))
    return each.select(book, F.explode(F.when(F.col("there"), on_page).otherwise(one("SOCIALS-PAGE-MISSING", ~F.col("there")))).alias("i")).select(book, "i.*")
