"""Texts: tokens, chunks by words, HTML to text, marks, citation numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenise(text: Column) -> Column:
    """Lower case, cut at white space, without characters other than A-Z, a-z, 0-9 and _, without empty tokens."""
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]+", "")
    return F.filter(F.split(kept, r"\s+"), lambda t: t != "")


def bigrams(tokens: Column) -> Column:
    n = F.size(tokens)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(tokens, i - 1), F.get(tokens, i)))
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(pairs)


def collapse(text: Column) -> Column:
    """White space to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def word_chunks(text: Column, size: int = 500) -> Column:
    """Array of (chunk_index, chunk_text) of `size` words each."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0))), lambda i: F.struct(i.alias("chunk_index"), F.array_join(F.slice(words, i * size + 1, size), " ").alias("chunk_text")))
    return F.filter(each, lambda c: c["chunk_text"] != "")


#: Entities that stored markup is decoded from, and named entities of pages.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}
NAMED = {
    "nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "mdash": "\u2014", "ndash": "\u2013", "hellip": "\u2026", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d",
    "bull": "\u2022", "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122", "deg": "\u00b0", "times": "\u00d7", "divide": "\u00f7", "plusmn": "\u00b1", "frac12": "\u00bd", "frac14": "\u00bc", "frac34": "\u00be",
    "micro": "\u00b5", "para": "\u00b6", "sect": "\u00a7", "laquo": "\u00ab", "raquo": "\u00bb", "euro": "\u20ac", "pound": "\u00a3", "yen": "\u00a5", "cent": "\u00a2",
}
#: What becomes of tags, in this order.
TAG_STEPS = (
    (r"(?is)<style[^>]*>.*?</style>", ""), (r"(?is)<script[^>]*>.*?</script>", ""), (r"(?i)</p>", "\n\n"), (r"(?i)</div>", "\n"), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</h[1-6]>", "\n\n"),
    (r"(?i)</li>", "\n"), (r"(?i)</tr>", "\n"), (r"(?i)</blockquote>", "\n\n"), (r"<[^>]*>", " "),
)


def decode_entities(text: Column) -> Column:
    """Stored markup: a few entities; the ampersand last, so that no entity is decoded twice."""
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)


def swap_matches(text: Column, pattern: str, new) -> Column:
    """text with every match m replaced by new(m): the gaps and the matches are zipped, so that new sees each match alone."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.array_join(F.transform(pieces, lambda x: F.concat(x["g"], F.when(x["m"].isNull(), F.lit("")).otherwise(new(x["m"])))), "")


def decode_all_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal entities, each once; unknown ones stay."""
    from itertools import chain

    names = F.create_map(*[F.lit(x) for x in chain(*NAMED.items())])

    def one(m: Column) -> Column:
        body = F.regexp_extract(m, "^&(.*);$", 1)
        code = F.when(body.rlike("^#[xX]"), F.conv(F.regexp_replace(body, "^#[xX]", ""), 16, 10)).otherwise(F.regexp_replace(body, "^#", "")).try_cast("long")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        named = F.coalesce(F.try_element_at(names, body), F.try_element_at(names, F.lower(body)), m)
        return F.when(body.startswith("#"), F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), char).otherwise(m)).otherwise(named)

    return F.when(text.contains("&"), swap_matches(text, r"&(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);", one)).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Plain text with the line structure of block tags; entities are decoded after tags have gone."""
    t = reduce(lambda c, step: F.regexp_replace(c, *step), TAG_STEPS, html)
    t = decode_all_entities(t)
    for pattern, new in ((r"[ \t]+", " "), (r"\n\s+", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        t = F.regexp_replace(t, pattern, new)
    return t


def strip_control(text: Column) -> Column:
    """Without control characters other than tab, line feed and return; null where nothing is left."""
    return F.nullif(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), F.lit(""))


#: Superscript digits 0 to 9.
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"


def from_superscript(text: Column) -> Column:
    return F.translate(text, SUPERSCRIPTS, "0123456789")


def to_superscript(number: Column) -> Column:
    return F.translate(number.cast("string"), "0123456789", SUPERSCRIPTS)


def has_superscript(text: Column) -> Column:
    return text.rlike(f"[{SUPERSCRIPTS}]")


def citation_numbers(text: Column, longest_range: int = 200) -> Column:
    """Sorted distinct numbers of lists and ranges: '1, 3-5' gives 1, 3, 4, 5. Ranges above longest_range count by their ends."""
    parts = F.split(F.regexp_replace(from_superscript(text), r"[–—]", "-"), r"[,;]")

    def numbers(part: Column) -> Column:
        lo, hi = (F.regexp_extract(part, r"(\d+)\s*-\s*(\d+)", i).try_cast("int") for i in (1, 2))
        one = F.regexp_extract(part, r"(\d+)", 1).try_cast("int")
        run = F.when(hi - lo <= longest_range, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array(lo, hi))
        return F.when(lo.isNotNull() & (hi >= lo), run).otherwise(F.array(one))

    return F.array_distinct(F.array_sort(F.filter(F.flatten(F.transform(parts, numbers)), lambda n: n.isNotNull())))


def number_ranges(numbers: Column) -> Column:
    """Sorted numbers as text, runs of three or more as ranges: 1-3,5."""
    n = F.array_sort(F.array_distinct(numbers))
    start = F.filter(n, lambda x: ~F.array_contains(n, x - 1))
    ends = F.filter(n, lambda x: ~F.array_contains(n, x + 1))

    def written(r: Column) -> Column:
        lo, hi = r["lo"], r["hi"]
        return F.when(lo == hi, lo.cast("string")).when(hi - lo == 1, F.concat_ws(",", lo.cast("string"), hi.cast("string"))).otherwise(F.concat_ws("-", lo.cast("string"), hi.cast("string")))

    return F.array_join(F.transform(F.arrays_zip(start.alias("lo"), ends.alias("hi")), written), ",")


def doi(text: Column) -> Column:
    """The first DOI in a text, without marks at its end; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(text, r"(10\.\d{4,}/[^\s\"<>]+)", 1), r"[.,;)\]]+$", "")


def slug(name: Column) -> Column:
    """A file name of a-z, 0-9, dot and hyphen."""
    return F.lower(F.regexp_replace(name, r"[^a-zA-Z0-9.-]", "_"))


def csv_safe(value: Column) -> Column:
    """Null as empty; a quote before cells that a spreadsheet would take for a formula."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(v.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), v)).otherwise(v)


def language_tag_ok(tag: Column) -> Column:
    """Two or three letters, then optional subtags."""
    return F.lower(tag).rlike(r"^[a-z]{2,3}(-[a-z0-9]{2,8})*$")


def scripts(text: Column) -> Column:
    """Languages by script; any ASCII character counts for en."""
    tests = {"en": r"[\x00-\x7F]", "zh": r"[\x{4E00}-\x{9FFF}]", "ja": r"[\x{3040}-\x{30FF}]", "ko": r"[\x{AC00}-\x{D7AF}]", "ar": r"[\x{0600}-\x{06FF}]", "he": r"[\x{0590}-\x{05FF}]", "ru": r"[\x{0400}-\x{04FF}]"}
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in tests.items()]), lambda x: x.isNotNull())
