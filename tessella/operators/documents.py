"""Texts: similarity, chunks, rules over patterns, page audits, content types, lines and blocks of pages."""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.functions.numbers import rate


#: Items of both sides that are counted at once within an Arrow batch; more rows follow in further turns.
OVERLAP_ITEMS = 1_000_000


def _shared_items(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """How many items the lists of each row share, counting repeats."""
    codes = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode(null_encoding="encode")
    at, many = codes.indices.to_numpy(), max(len(codes.dictionary), 1)
    sizes = [np.diff(x.offsets.to_numpy()) for x in (a, b)]
    rows = np.concatenate([np.repeat(np.arange(len(a)), n) for n in sizes])
    spots = rows * many + at
    cut = int(sizes[0].sum())
    (x, nx), (y, ny) = (np.unique(s, return_counts=True) for s in (spots[:cut], spots[cut:]))
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return np.bincount(both // many, np.minimum(nx[i], ny[j]), len(a)).astype(np.int64)


def multiset_overlap(pairs: DataFrame, key: str, a: Column, b: Column, whole: str = "union", at_once: int = OVERLAP_ITEMS) -> DataFrame:
    """key, similarity: shared over all (`union`) or over the larger side (`max`), counting repeats; a and b are arrays of strings.

    Both sides stand in one row, so no row moves: items of some rows at a time are counted in numpy, at_once of them
    or one row. A null or empty array shares nothing: similarity 0. Every row of pairs gives one row, repeated keys too.
    """
    none = F.array().cast("array<string>")
    sides = pairs.select(key, F.coalesce(a, none).alias("_a"), F.coalesce(b, none).alias("_b"))

    def run(batches):
        for batch in batches:
            x, y = batch.column(1), batch.column(2)
            ends = np.cumsum(pc.list_value_length(x).to_numpy() + pc.list_value_length(y).to_numpy())
            first = 0
            while first < batch.num_rows:
                upto = np.searchsorted(ends, (ends[first - 1] if first else 0) + at_once, "right")
                n = max(int(upto) - first, 1)
                p, q = x.slice(first, n), y.slice(first, n)
                yield pa.record_batch([batch.column(0).slice(first, n), pa.array(_shared_items(p, q)), pc.list_value_length(p).cast("int64"), pc.list_value_length(q).cast("int64")], [key, "_n", "_x", "_y"])
                first += n

    kind = sides.schema[key].dataType.simpleString()
    counted = sides.mapInArrow(run, f"`{key}` {kind}, _n bigint, _x bigint, _y bigint")
    total = F.col("_x") + F.col("_y") - F.col("_n") if whole == "union" else F.greatest("_x", "_y")
    return counted.select(key, rate(F.col("_n"), total).alias("similarity"))


def _tokens(text: str) -> list[str]:
    return [w for w in (re.sub(r"[^a-zA-Z0-9_]", "", x) for x in text.lower().split()) if w]


def common_subsequence(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence: a bit for each item of the shorter list, a row of the table for each of the longer.

    A zero bit says that the table's row grows there; one addition carries all steps of a row, so lists of 20,000 items
    take 20,000 operations on numbers of 20,000 bits and no table.
    """
    x, y = sorted((x, y), key=len)
    at: dict[str, int] = {}
    for i, w in enumerate(x):
        at[w] = at.get(w, 0) | 1 << i
    whole = (1 << len(x)) - 1
    row = whole
    for w in y:
        if hit := row & at.get(w, 0):
            row = ((row + hit) | (row ^ hit)) & whole
    return len(x) - row.bit_count()


def sequence_similarity(a: str, b: str, cells: int | None = None) -> float:
    """Longest common subsequence of tokens over the longer side, 1 for equal texts, 0 where one has no tokens.

    cells: pairs whose lengths multiply to more take shared pairs of neighbours instead; None, the default, takes no such pair.
    """
    if a == b:
        return 1.0
    x, y = _tokens(a), _tokens(b)
    if not x or not y:
        return 0.0
    if cells is not None and len(x) * len(y) > cells:
        if min(len(x), len(y)) < 2:
            return float(x == y)
        p, q = Counter(zip(x, x[1:], strict=False)), Counter(zip(y, y[1:], strict=False))
        return sum((p & q).values()) / max(len(x) - 1, len(y) - 1)
    return common_subsequence(x, y) / max(len(x), len(y))


def sequence_similarities(pairs: DataFrame, key: str, a: str, b: str, cells: int | None = None) -> DataFrame:
    """key, similarity of sequence_similarity; a subsequence has no built-in, so pairs go through Arrow batches. A null is an empty text."""

    def run(batches):
        for batch in batches:
            s = [sequence_similarity(x or "", y or "", cells) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(s, pa.float64())], [key, "similarity"])

    return pairs.select(key, a, b).mapInArrow(run, f"{key} {pairs.schema[key].dataType.simpleString()}, similarity double")


def cut_text(text: str, size: int) -> list[tuple[int, str]]:
    """(offset, chunk): cuts after a blank line, else after a sentence, in the second half of each stretch of size, else at its end."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            for mark in ("\n\n", ". "):
                k = text.rfind(mark, 0, end + len(mark))
                if k > at + size / 2:
                    end = k + 2
                    break
        out.append((at, text[at:end]))
        at = end
    return out


def pack_sentences(text: str, words: int) -> list[tuple[int, str]]:
    """(offset, chunk) of whole sentences with up to `words` words; a longer sentence is a chunk of its own."""
    out, start, n = [], None, 0
    end = 0
    for m in re.finditer(r"[^.!?]*[.!?]+\s*|[^.!?]+$", text):
        k = len(m[0].split())
        if start is not None and n + k > words:
            out.append((start, text[start:end]))
            start, n = None, 0
        if start is None:
            start = m.start()
        n, end = n + k, m.end()
    if start is not None:
        out.append((start, text[start:end]))
    return out


def chunks(docs: DataFrame, key: str, text: str, cutter, *args) -> DataFrame:
    """key, chunk_index, start, chunk: one row for each chunk that cutter(text, *args) gives."""

    def run(batches):
        for batch in batches:
            at, index, start, chunk = [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                for n, (o, c) in enumerate(cutter(t or "", *args)):
                    at.append(row), index.append(n), start.append(o), chunk.append(c)
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), pa.array(start, pa.int64()), pa.array(chunk, pa.string())], [key, "chunk_index", "start", "chunk"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, chunk_index int, start bigint, chunk string")


# fmt: off
#: Rules of style as (id, guide, severity, pattern, what instead). Lists of words are parts of a pattern.
STYLE_RULES = (
    ("punct-serial-comma", "common", "WARNING", r"(?i)(\w+),\s+(\w+)\s+and\s+(\w+)", "a comma before and"),
    ("punct-double-space", "common", "WARNING", r"\.\s{2,}", "one blank"),
    ("punct-comma-splice", "common", "WARNING", r"(?i),\s+(I|he|she|it|they|we|you|this|that|these|those)\s+\w+", "a semicolon"),
    ("cap-sentence-start", "common", "ERROR", r"(?<=[.!?] )[a-z]", "a capital"),
    ("num-spell-out-small", "common", "WARNING", r"(?<![\d$%€£¥#/:\-.])[1-9](?![\d/:\-.])", "the number's word"),
    ("num-percent", "common", "WARNING", r"(?i)(\d+)\s+percent", "%"),
    ("gram-passive-voice", "common", "SUGGESTION", r"(?i)\b(was|were|been|being|is|are|am)\s+(being\s+)?(\w+ed)\b", "active voice"),
    ("term-utilize", "common", "SUGGESTION", r"(?i)\butilize[sd]?\b", "use"),
    ("term-impact-verb", "common", "SUGGESTION", r"(?i)\b(impacts|impacted|impacting)\b", "affect"),
    ("term-very", "common", "SUGGESTION", r"(?i)\bvery\s+(\w+)", "a stronger word"),
    ("abbr-eg-ie", "common", "WARNING", r"(?i)\b(e\.g\.|i\.e\.)(?!,)", "a comma after"),
    ("abbr-etc", "common", "WARNING", r"(?i)([^,])\s+etc\.", "a comma before"),
    ("chicago-en-dash", "chicago", "WARNING", r"(\d+)-(\d+)", "an en dash"),
    ("chicago-em-dash-spaces", "chicago", "WARNING", r"\s+—\s+", "no blanks"),
    ("chicago-possessive-singular", "chicago", "SUGGESTION", r"\b([A-Z][a-z]*s)'\s", "'s"),
    ("chicago-that-which", "chicago", "SUGGESTION", r"(?i)[^,]\s+which\s+", "that"),
    ("chicago-towards", "chicago", "SUGGESTION", r"(?i)\btowards\b", "toward"),
    ("chicago-amongst", "chicago", "SUGGESTION", r"(?i)\bamongst\b", "among"),
    ("chicago-whilst", "chicago", "SUGGESTION", r"(?i)\bwhilst\b", "while"),
    ("chicago-ibid-discouraged", "chicago", "SUGGESTION", r"\b[Ii]bid\.(\s*,\s*\d+)?", "a short citation"),
    ("chicago-ellipsis-spacing", "chicago", "SUGGESTION", r"\.{3}", "spaced periods"),
    ("apa-singular-they", "apa", "SUGGESTION", r"(?i)\b(he or she|she or he|him or her|her or him|his or her|her or his)\b", "they"),
    ("apa-et-al", "apa", "ERROR", r"(?i)\bet\s+al(?!\.)", "et al."),
    ("apa-percent", "apa", "WARNING", r"(?i)(\d+)\s+percent", "%"),
    ("apa-no-contractions", "apa", "WARNING", r"(?i)\b(\w+n't|\w+'(?:re|ve|ll)|it's|let's|that's|i'm)\b", "the full form"),
    ("apa-number-plural-apostrophe", "apa", "ERROR", r"\b(\d{4})'s\b", "no apostrophe"),
    ("apa-doi-format", "apa", "WARNING", r"(?i)\bdoi:\s*(\d+\.\d+/[^\s]+)", "a link"),
    ("mla-numbers", "mla", "WARNING", r"\b(100|1000|1,000)\b", "words"),
    ("mla-date-format", "mla", "SUGGESTION", r"\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{1,2}),\s+(\d{4})\b", "day month year"),
    ("ap-no-oxford-comma", "ap", "WARNING", r"(?i)(\w+),\s+(\w+),\s+and\s+", "no comma before and"),
    ("ap-percent-spelled", "ap", "WARNING", r"(\d+)%", "percent"),
    ("vancouver-date-format", "vancouver", "SUGGESTION", r"\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{1,2}),?\s+(\d{4})\b", "year month day"),
    ("vancouver-page-range", "vancouver", "SUGGESTION", r"\b(\d{2,})[-–](\d{2,})\b", "shortened end"),
    ("quality-split-infinitive", "quality", "SUGGESTION", r"(?i)\bto\s+(\w+ly)\s+(\w+)", "the adverb elsewhere"),
    ("ieee-first-person", "publisher", "SUGGESTION", r"(?i)\b(I|my|mine)\b(?!\s+(will|would|could|should|may|might|can))", "third person"),
    ("ieee-equation-refs", "publisher", "WARNING", r"\b[Ee]q\.\s*\(?(\d+)\)?", "(n)"),
)
#: Words and phrases that rules of style look for.
GENDERED = ("mankind", "manmade", "man-made", "manpower", "chairman", "fireman", "policeman", "stewardess", "waitress", "mailman")
UNITS = ("inches", "inch", "feet", "foot", "pounds", "pound", "ounces", "ounce", "miles", "mile", "gallons", "gallon")
LAY_TERMS = ("heart attack", "stroke", "high blood pressure", "sugar diabetes", "water pill", "pain killer", "blood thinner")
REDUNDANT = (
    "advance planning", "basic fundamentals", "close proximity", "completely eliminate", "consensus of opinion", "end result", "exact same", "free gift", "future plans",
    "general consensus", "new innovation", "past history", "personal opinion", "previous experience", "repeat again", "revert back", "sum total", "unexpected surprise",
    "whether or not", "each and every", "first and foremost", "various different", "absolutely essential", "actual fact", "added bonus", "advance warning",
)
WORDY = (
    "at this point in time", "due to the fact that", "in order to", "in the event that", "in spite of the fact that", "with regard to", "with respect to", "for the purpose of",
    "in the near future", "at the present time", "on a daily basis", "on a regular basis", "in a timely manner", "make a decision", "take into consideration",
    "give consideration to", "make an attempt", "come to a conclusion", "is able to", "has the ability to", "in close proximity to", "a large number of", "a small number of",
    "the majority of", "in the absence of", "subsequent to", "prior to",
)
CLICHES = (
    "at the end of the day", "think outside the box", "paradigm shift", "low-hanging fruit", "move the needle", "synergy", "leverage", "best practices", "value-added", "win-win",
    "circle back", "deep dive", "game changer", "disrupt",
)
AMERICAN = ("color", "favor", "honor", "behavior", "analyze", "organize", "realize", "center", "meter", "fiber")


def _any(words: tuple[str, ...], before: str = r"\b") -> str:
    return rf"(?i){before}(?:{'|'.join(words)})\b"


STYLE_RULES += (
    ("apa-bias-free-gender", "apa", "WARNING", _any(GENDERED), "a neutral word"),
    ("apa-anthropomorphism", "apa", "SUGGESTION", r"(?i)\bthe (study|paper|research|data|results?) (shows?|demonstrates?|argues?|believes?|thinks?|feels?)\b|\bthe (table|figure|graph) (shows?|illustrates?)\b", "indicates"),
    ("ap-time-format", "ap", "SUGGESTION", r"(?i)12:00\s*[ap]\.?m\.?", "noon or midnight"),
    ("vancouver-units", "vancouver", "WARNING", _any(UNITS, r"\d+\s*"), "metric units"),
    ("vancouver-medical-terms", "vancouver", "WARNING", _any(LAY_TERMS), "the medical term"),
    ("quality-redundancy", "quality", "SUGGESTION", _any(REDUNDANT), "one of the words"),
    ("quality-wordy", "quality", "SUGGESTION", _any(WORDY), "a shorter phrase"),
    ("quality-cliches", "quality", "SUGGESTION", _any(CLICHES), "plain words"),
    ("nature-british-spelling", "publisher", "WARNING", _any(AMERICAN), "the British spelling"),
)
# fmt: on


def safe_pattern(pattern: str) -> bool:
    """Whether a rule from outside may run: it compiles, is short, and repeats no repetition."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return len(pattern) <= 500 and not re.search(r"\([^)]*[+*][^)]*\)[+*]", pattern)


def apply_rules(docs: DataFrame, key: str, text: str, rules: list[tuple[str, str]], limit: int | None = None) -> DataFrame:
    """key, rule, start, end, match of every match, in characters; rules: (id, pattern), unsafe ones are left out.

    limit: texts of more characters match no rule, for rules that take time squared in a word of such length; None reads all.
    A null text has no matches.

    Each rule is one pass of the JVM's matcher over a text, all in one projection: gaps between matches give the offsets.
    """
    t = F.col(text)
    kinds = "array<struct<rule:string,start:int,end:int,match:string>>"

    def of(rule: str, pattern: str) -> Column:
        found = F.arrays_zip(F.transform(F.split(t, pattern, -1), F.char_length).alias("g"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(kinds).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            lo = acc["at"] + x["g"]
            hi = lo + F.coalesce(F.char_length(x["m"]), F.lit(0))
            row = F.array(F.struct(F.lit(rule).alias("rule"), lo.alias("start"), hi.alias("end"), x["m"].alias("match")))
            return F.struct(hi.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], row)).alias("out"))

        return F.when(t.rlike(pattern), F.aggregate(found, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(kinds))

    every = F.concat(*[of(r, p) for r, p in rules if safe_pattern(p)])
    docs = docs if limit is None else docs.where(F.char_length(t) <= limit)
    return docs.select(key, F.explode(every).alias("r")).select(key, "r.*")


_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


class Phrases:
    """Many phrases looked up in one pass over a text, whole words, ASCII letters in any case.

    rules: (id, phrase, fixed). Where fixed is set, the phrase in its own spelling is no match. As with a pattern for each
    rule, matches of one rule don't overlap: of those that do the leftmost counts. Empty phrases match nothing.
    """

    def __init__(self, rules: list[tuple[str, str, bool]]):
        by: dict[str, list[int]] = {}
        for k, (_, phrase, _) in enumerate(rules):
            if phrase:
                by.setdefault(phrase.translate(_ASCII_LOWER), []).append(k)
        self.rules, self._automaton = rules, ahocorasick.Automaton()
        for low, ks in by.items():
            self._automaton.add_word(low, (len(low), ks))
        if by:
            self._automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(rule, start, end) of every match, in code points, by end."""
        if not self.rules or not len(self._automaton):
            return []
        out, last = [], {}
        for end, (size, ks) in self._automaton.iter(text.translate(_ASCII_LOWER)):
            start, end = end - size + 1, end + 1
            before, after = text[start - 1 : start] in _WORD_CHARS, text[end : end + 1] in _WORD_CHARS
            if before == (text[start] in _WORD_CHARS) or after == (text[end - 1] in _WORD_CHARS):
                continue
            for k in ks:
                _, phrase, fixed = self.rules[k]
                if start >= last.get(k, 0) and not (fixed and text[start:end] == phrase):
                    last[k] = end
                    out.append((k, start, end))
        return out


def phrase_rules(docs: DataFrame, key: str, text: str, rules: list[tuple[str, str, bool]]) -> DataFrame:
    """key, rule, start, end, match of every match of Phrases(rules), in characters; a null text has none.

    The automaton of all phrases is broadcast once (rules are a list that the caller holds); a text is read once, however
    many phrases there are, and no row moves between tasks.
    """
    ship = docs.sparkSession.sparkContext.broadcast(rules)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "rule", "start", "end", "match"]

    def run(batches):
        phrases = Phrases(ship.value)
        for batch in batches:
            rows, rule, start, end, match = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for k, a, b in phrases.find(t or ""):
                    rows.append(i)
                    rule.append(phrases.rules[k][0])
                    start.append(a)
                    end.append(b)
                    match.append(t[a:b])
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(rule, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(match, pa.string())], names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, rule string, start int, end int, match string")


def house_rules(docs: DataFrame, key: str, text: str, rules: list[dict]) -> DataFrame:
    """key, rule, start, end, match of rules stored as data: kind PATTERN (pattern), TERMINOLOGY (avoid) or CAPITALIZATION
    (term whose spelling is fixed). Whole texts are read; phrases of all rules in one pass, each pattern in one of its own."""
    words = [(r["id"], r["avoid"], False) if r["kind"] == "TERMINOLOGY" else (r["id"], r["term"], True) for r in rules if r["kind"] in ("TERMINOLOGY", "CAPITALIZATION")]
    patterns = [(r["id"], r["pattern"]) for r in rules if r["kind"] not in ("TERMINOLOGY", "CAPITALIZATION")]
    if not words:
        return apply_rules(docs, key, text, patterns)
    found = phrase_rules(docs, key, text, words)
    return found.unionByName(apply_rules(docs, key, text, patterns)) if patterns else found


def audit_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, code, severity, n of the issues of a page: language, alternative texts, empty links, table headers, headings, landmark."""
    h = F.regexp_replace(F.regexp_replace(F.col(html), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", ""), r"(?s)<!--.*?-->", "")

    def n(pattern: str) -> Column:
        return F.regexp_count(h, F.lit(pattern))

    levels = F.transform(F.regexp_extract_all(h, F.lit(r"(?i)<h([1-6])\b"), F.lit(1)), lambda x: x.cast("int"))
    skips = F.size(F.filter(F.transform(levels, lambda x, i: (i > 0) & (x > F.coalesce(F.get(levels, i - 1), F.lit(9)) + 1)), lambda x: x))
    # fmt: off
    checks = (
        ("EPUB-SEM-001", "serious", F.when(h.rlike(r"(?i)<html\b[^>]*\slang\s*="), 0).otherwise(1)),
        ("EPUB-SEM-002", "moderate", n(r"(?is)<a\b[^>]*>\s*</a>")),
        ("EPUB-IMG-001", "critical", n(r"(?i)<img\b(?![^>]*\salt\s*=)[^>]*>")),
        ("EPUB-STRUCT-002", "serious", F.when(h.rlike(r"(?i)<table\b") & ~h.rlike(r"(?i)<th\b"), 1).otherwise(0)),
        ("EPUB-STRUCT-003", "moderate", F.least(skips, F.lit(1))),
        ("EPUB-STRUCT-004", "minor", F.when(h.rlike(r"(?i)<main\b|role\s*=\s*[\"']main[\"']"), 0).otherwise(1)),
    )
    # fmt: on
    rows = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), k.cast("int").alias("n")) for c, s, k in checks])
    return pages.select(key, F.explode(F.filter(rows, lambda r: r["n"] > 0)).alias("i")).select(key, "i.*")


def heading_report(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, headings, skipped levels, empty headings, number of first-level headings, missing one."""
    h = F.regexp_replace(F.col(html), r"(?is)<script[^>]*>.*?</script>", "")
    levels = F.transform(F.regexp_extract_all(h, F.lit(r"(?i)<h([1-6])\b"), F.lit(1)), lambda x: x.cast("int"))
    p = pages.select(key, levels.alias("l"), F.regexp_count(h, F.lit(r"(?is)<h([1-6])\b[^>]*>\s*</h\1>")).alias("empty"))
    each = p.select(key, F.posexplode("l").alias("at", "level"))
    jump = F.col("level") - F.lag("level").over(Window.partitionBy(key).orderBy("at"))
    skipped = each.withColumn("jump", jump).groupBy(key).agg(F.count_if(F.col("jump") > 1).alias("skipped"))
    first = F.size(F.filter("l", lambda x: x == 1))
    return p.join(skipped, key, "left").select(key, F.size("l").alias("headings"), F.coalesce("skipped", F.lit(0)).alias("skipped"), "empty", first.alias("first_level"), (first == 0).alias("missing_first"))


#: Signals of journal articles and books: name, where to look (early, all, count twice), pattern, points.
JOURNAL_SIGNALS = (("abstract-heading", "early", r"(?i)\b(abstract)\b", 3), ("keywords-section", "early", r"(?i)\bkeywords?\s*:", 2), ("doi-identifier", "all", r"10\.\d{4,}/", 2), ("corresponding-author", "early", r"(?i)\b(corresponding\s+author|correspondence)\b", 2), ("orcid", "early", r"(?i)orcid", 1), ("received-accepted-dates", "early", r"(?i)\b(received|accepted|published)\s*:?\s*\d", 2))
BOOK_SIGNALS = (("table-of-contents", "early", r"(?im)(?:^|\n)\s*(?:table\s+of\s+contents|contents)\s*(?:\n|$)", 4), ("chapter-headings", "twice", r"(?i)\bchapter\s+\d+", 4), ("isbn", "all", r"(?i)\bISBN\b", 3))


def content_type(text: Column) -> dict[str, Column]:
    """journal_score, book_score, content_type (the higher one; unknown where equal) of a text."""
    early = F.left(text, F.lit(3000))

    def score(signals) -> Column:
        total = F.lit(0)
        for _, where, pattern, points in signals:
            hit = F.regexp_count(text, F.lit(pattern)) >= 2 if where == "twice" else (early if where == "early" else text).rlike(pattern)
            total = total + F.when(hit, points).otherwise(0)
        return total

    j, b = score(JOURNAL_SIGNALS), score(BOOK_SIGNALS)
    return {"journal_score": j, "book_score": b, "content_type": F.when(j > b, "JOURNAL").when(b > j, "BOOK").otherwise("UNKNOWN")}


def contents_score(leaders: Column, page_refs: Column, outline: Column, before_first: Column) -> Column:
    """Score of a contents page: dotted leaders, page numbers at line ends, outline titles, place before the first chapter."""
    parts = ((leaders, 0.35), (page_refs, 0.35), (outline, 0.20), (before_first, 0.10))
    total = F.lit(0.0)
    for c, w in parts:
        total = total + F.when(c, w).otherwise(0.0)
    return F.least(F.lit(1.0), total)


def lines_of_page(items: DataFrame, keys: list[str], order: list[str], threshold: float = 3.0) -> DataFrame:
    """items + line: an item joins the line whose first item is at most threshold away in y, else starts the next line.

    The anchor moves when a line breaks, so a page's items are walked in order.
    """
    from tessella.operators.kernels import Columns, per_group

    def page(g: Columns) -> Columns:
        line, anchor, out = 0, None, []
        for y in g["y"].tolist():
            if anchor is None or abs(y - anchor) > threshold:
                line, anchor = line + 1, y
            out.append(line)
        return {**{c: g[c] for c in [*order, "x", "y", "w", "h"]}, "line": np.array(out, np.int64)}

    out = {**{c: items.schema[c].dataType.simpleString() for c in order if c not in ("x", "y")}, "x": "double", "y": "double", "w": "double", "h": "double", "line": "bigint"}
    return per_group(items, keys, ["y", "x", *[c for c in order if c not in ("x", "y")]], [*[c for c in order if c not in ("x", "y")], "x", "y", "w", "h"], lambda g: {k: v for k, v in page(g).items() if k in out}, out)


def line_boxes(lines: DataFrame, keys: list[str], large: float = 22.0) -> DataFrame:
    """keys, line, envelope, mean height, heading where an item is at least `large` high."""
    return lines.groupBy(*keys, "line").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"), F.avg("h").alias("mean_h"), F.bool_or(F.col("h") >= large).alias("heading"), F.count("*").alias("n"))


def blocks(lines: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """lines + block: a new one where the gap to the line before is larger, or after a heading."""
    by = Window.partitionBy(*keys).orderBy("y", "line")
    new = F.lag("bottom").over(by).isNull() | (F.col("y") - F.lag("bottom").over(by) > gap) | F.coalesce(F.lag("heading").over(by), F.lit(False))
    return lines.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("block", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def block_kind(text: Column, heading: Column, y: Column, page_height: float) -> Column:
    """heading, list, header, footer, caption or paragraph."""
    return F.when(heading, "heading").when(text.rlike(r"^\s*([•\-*]|\d+[.)])\s"), "list").when(y < 0.08 * page_height, "header").when(y > 0.92 * page_height, "footer").when(text.rlike(r"(?i)^\s*(figure|fig\.|table)\s+\d"), "caption").otherwise("paragraph")


def heading_level_by_size(size: Column, usual: Column) -> Column:
    r = size / usual
    return F.when(r >= 2.0, 1).when(r >= 1.7, 2).when(r >= 1.4, 3).when(r >= 1.2, 4).otherwise(5)


def column_positions(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x rounded to tens: kept where at least half as many items as lines start there."""
    n = lines.groupBy(*keys).agg(F.countDistinct("line").alias("n_lines"))
    at = lines.groupBy(*keys, (F.floor(F.col("x") / 10 + 0.5) * 10).alias("column")).agg(F.count("*").alias("n"))
    return at.join(n, keys).where(F.col("n") >= F.col("n_lines") * 0.5)


def reading_direction(pages: DataFrame, keys: list[str]) -> DataFrame:
    """rtl or ltr by a majority of two to one, else mixed; pages: rtl_votes, ltr_votes."""
    r, l = F.sum("rtl_votes"), F.sum("ltr_votes")
    return pages.groupBy(*keys).agg(F.when(r > 2 * l, "rtl").when(l > 2 * r, "ltr").otherwise("mixed").alias("direction"))


def contexts(items: DataFrame, keys: list[str], order: list[str], is_heading: Column, text: str) -> DataFrame:
    """items + before, after (neighbours' texts) and nearest_heading (the last one before)."""
    by = Window.partitionBy(*keys).orderBy(*order)
    heading = F.last(F.when(is_heading, F.col(text)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return items.withColumns({"before": F.lag(text).over(by), "after": F.lead(text).over(by), "nearest_heading": heading})


def collapse_spaces(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn(text, tx.collapse(F.col(text)))
