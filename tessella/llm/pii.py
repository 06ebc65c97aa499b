"""Personal data: fixed patterns with checks, and bootstrapped contextual extraction. Native: DataFrame functions only.

Bootstrapping: what the fixed patterns find and their checks pass is a seed, blanks or not; a long token that mixes letters
and digits, as keys and secrets do, is half a seed. The words around them make lexical patterns; patterns and tokens form
a graph whose two sides score each other for some rounds; tokens that trusted patterns find are identifiers too, though
no fixed pattern knows them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST, _GAP = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]", r"\x20\x09-\x0D"
#: The same matches as the plain patterns, without backing up: a local part or number starts where its run of
#: characters starts, or (\G) where the match before ended; what follows is possessive.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TRIGGER = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Tokens with a digit or an at sign.
TOKEN = rf"(?<![^{_GAP}])[^{_GAP}0-9@]*+[0-9@][^{_GAP}]*+"
_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE = 6, 3, 0.8
#: Score of a token that looks like a key before any pattern has found it: too low to count by itself.
HALF_SEED = 0.5
#: A token has so many digits or an at sign; what has neither is never looked at.
MIN_DIGITS = 4
#: A word tells something if so large a share of all its occurrences in the corpus stand within two words of a token.
TELLING = 0.2
#: Up to so many bytes of ids and discovered tokens are broadcast for masking.
SENT_BYTES = 4 << 20
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, d: Column) -> Column:
        return total + d

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int") * (F.lit(1) + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(_PARTS)
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _bare(token: Column) -> Column:
    """The token without marks at its ends."""
    return F.regexp_replace(F.regexp_replace(token, "^[^A-Za-z0-9]+", ""), "[^A-Za-z0-9]+$", "")


def _head(text: Column) -> Column:
    """Up to three words at the start, with the blanks around them. Possessive, so that long words cost no second look."""
    return F.regexp_extract(text, rf"^[{_GAP}]*+(?:[^{_GAP}]++[{_GAP}]*+){{0,3}}", 0)


def _tail(text: Column) -> Column:
    return F.reverse(_head(F.reverse(text)))


def _found(text: Column, kind: str, pattern: str, trigger: str) -> Column:
    """Array of (kind, gap: code points since the match before, m: match or null at the end, before, after: the words next to it)."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<kind:string,gap:int,m:string,before:string,after:string>>")

    def later(x: Column, by: int) -> Column:
        return F.slice(x, F.lit(1 + by), F.size(x))

    def earlier(x: Column, by: int) -> Column:
        return F.concat(F.array_repeat(F.lit(None).cast("string"), by), x)

    # Neighbours are zipped in: named inside the function, the arrays would be made anew for every element.
    parts = [gaps.alias("g"), hits.alias("m"), later(gaps, 1).alias("next"), later(hits, 1).alias("then")]
    if kind == "token":  # tokens are context too, so a window may reach beyond them
        parts += [earlier(hits, 1).alias("m1"), earlier(gaps, 1).alias("g1"), earlier(hits, 2).alias("m2"), later(gaps, 2).alias("next2"), later(hits, 2).alias("then2")]

    def near(x: Column, i: Column) -> tuple[Column, Column]:
        before, after = _tail(x["g"]), _head(x["next"])
        whole = F.char_length(before) == F.char_length(x["g"]), F.char_length(after) == F.char_length(x["next"])
        if kind == "token":
            before = F.when(whole[0] & x["m1"].isNotNull(), F.concat_ws("", x["m2"], _tail(x["g1"]), x["m1"], before)).otherwise(before)
            after = F.when(whole[1] & x["then"].isNotNull(), F.concat_ws("", after, x["then"], _head(x["next2"]), x["then2"])).otherwise(after)
            return before, after
        # Matches may lie within words: a word that another match cuts, or that goes on into this one, is no context; marks are none.
        before = F.when((i > 0) & whole[0], F.regexp_replace(before, rf"^[^{_GAP}]+", "")).otherwise(before)
        before = F.regexp_replace(before, rf"(?<![^{_GAP}])[^{_GAP}A-Za-z0-9]++$", "")
        after = F.when(x["then"].isNotNull() & whole[1], F.regexp_replace(after, rf"(?<![^{_GAP}])[^{_GAP}]++$", "")).otherwise(after)
        after = F.regexp_replace(after, rf"^[^{_GAP}A-Za-z0-9]++", "")
        counts = F.coalesce(valid(kind, x["m"]), F.lit(False))
        return F.when(counts & before.rlike(rf"[{_GAP}]$"), before), F.when(counts & after.rlike(rf"^[{_GAP}]"), after)

    def entry(x: Column, i: Column) -> Column:
        before, after = near(x, i)
        return F.struct(F.lit(kind).alias("kind"), F.char_length(x["g"]).alias("gap"), x["m"].alias("m"), before.alias("before"), after.alias("after"))

    # Shifted arrays are longer or shorter than gaps: only what has a gap is an entry.
    zipped = F.slice(F.arrays_zip(*parts), F.lit(1), F.size(gaps))
    return F.when(text.rlike(trigger), F.transform(zipped, entry)).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, finds): rows(row, doc_id) of all of docs; finds(row, kind, start, end, m, before, after) of every match and token,
    start and end in code points. Texts are read once; what is kept of them are the matches and what stands next to them."""
    text = common.text_of(text_col)
    both = [*((k, PATTERNS[k], _TRIGGER[k]) for k in KINDS), ("token", TOKEN, "[0-9@]")]
    kept = docs.select(F.col(id_col).alias("doc_id"), F.concat(*[_found(text, *x) for x in both]).alias("found"))
    kept = common.materialize(kept.withColumn("row", F.monotonically_increasing_id()), "matches")
    each = kept.where(F.size("found") > 0).select("row", F.posexplode("found").alias("at", "f")).select("row", "at", "f.*").where("m IS NOT NULL")
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("m")).over(upto)
    return kept.select("row", "doc_id"), each.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("m"))


def _is_valid() -> Column:
    out = F.lit(False)
    for k in KINDS:
        out = F.when(F.col("kind") == k, valid(k, F.col("m"))).otherwise(out)
    return out


def candidates(finds: DataFrame) -> DataFrame:
    """(row, start, end, token, before, after) of tokens with enough digits, or an at sign, without marks at their ends."""
    t = finds.where("kind = 'token'").withColumn("token", _bare(F.col("m")))
    t = t.where((F.length(_digits(F.col("token"))) >= MIN_DIGITS) | F.col("token").contains("@"))
    skip = F.char_length(F.regexp_extract("m", "^[^A-Za-z0-9]+", 0))
    return t.select("row", (F.col("start") + skip).alias("start"), (F.col("start") + skip + F.char_length("token")).alias("end"), "token", "before", "after")


def occurrences(finds: DataFrame) -> DataFrame:
    """(row, start, end, token, seed, before, after): valid matches of the fixed patterns, which are seeds, and candidates that touch none in their row."""
    base = finds.where(F.col("kind") != "token").where(_is_valid())
    both = base.select("row", "start", "end", F.col("m").alias("token"), F.lit(True).alias("seed"), "before", "after")
    both = both.unionByName(candidates(finds).withColumn("seed", F.lit(False)))
    # Of what starts before a candidate the furthest end counts, of what starts after it the first start.
    up = Window.partitionBy("row").orderBy("start")
    earlier = F.max(F.when(F.col("seed"), F.col("end"))).over(up)
    later = F.min(F.when(F.col("seed"), F.col("start"))).over(up.rangeBetween(0, Window.unboundedFollowing))
    both = both.withColumn("earlier", earlier).withColumn("later", later)
    alone = (F.coalesce("earlier", "start") <= F.col("start")) & (F.coalesce("later", "end") >= F.col("end"))
    return both.where(F.col("seed") | alone).drop("earlier", "later")


def _like_a_key(token: Column) -> Column:
    """20 letters, digits, low lines and hyphens or more, six of them digits and six letters, ten different ones."""
    letters, digits = F.length(F.regexp_replace(token, "[^A-Za-z]", "")), F.length(_digits(token))
    return token.rlike("^[A-Za-z0-9_-]{20,}$") & (letters >= 6) & (digits >= 6) & (F.size(F.array_distinct(F.split(token, ""))) >= 10)


def _mere_number(token: Column) -> Column:
    return ~token.rlike(r"[\p{L}@]")


def _neighbours() -> tuple[Column, Column, Column, Column]:
    """The word before, the one before that, the word after, the one after that; figures in words are all one, mere numbers
    and words with an at sign are none."""

    def word(side: str, at: int) -> Column:
        found = F.try_element_at(F.filter(F.split(F.lower(side), rf"[{_GAP}]+"), lambda w: w != ""), F.lit(at))
        mere = found.contains("@") | (found.rlike("[0-9]") & ~found.rlike(r"\p{L}"))
        return F.when(~mere, F.regexp_replace(found, "[0-9]+", "0"))

    return word("before", -1), word("before", -2), word("after", 1), word("after", 2)


def edges(found: DataFrame, telling: DataFrame | None = None) -> DataFrame:
    """Distinct (pattern, side, token, prior): one and two words before a token, one and two words after it, and the word before with the word after.

    Any words make a pattern: what stands before anything gets a low confidence. telling (word): patterns without such a word
    are left out. Mere numbers that are no seeds stand in no pattern of a single word, as numbers follow any word. side: `one`
    for words of one side, else `both`. prior: 1 of a seed, HALF_SEED, or 0.
    """
    one, two, right, next_ = _neighbours()

    def pattern(side: str, label: str, *words: Column) -> Column:
        text = F.concat(F.lit(label), *[x for i, w in enumerate(words) for x in ([F.lit(" _ " if side == "both" else " ")] if i else []) + [w]])
        return F.struct(text.alias("pattern"), F.lit(side).alias("side"), F.array(*words).alias("words"))

    kinds = F.array(pattern("one", "before:", one), pattern("one", "before:", two, one), pattern("one", "after:", right), pattern("one", "after:", right, next_), pattern("both", "around:", one, right))
    prior = F.when(F.col("seed"), F.lit(1.0)).when(_like_a_key(F.col("token")), F.lit(HALF_SEED)).otherwise(F.lit(0.0))
    each = found.select("token", "seed", prior.alias("prior"), F.explode(kinds).alias("p")).where("p.pattern IS NOT NULL")
    each = each.where(F.col("seed") | ~_mere_number(F.col("token")) | (F.size("p.words") > 1)).select("p.pattern", "p.side", "p.words", "token", "prior")
    if telling is not None:
        each = each.withColumn("word", F.explode("words")).join(telling.select("word"), "word")
    return each.select("pattern", "side", "token", "prior").distinct()


def telling_words(texts: DataFrame, found: DataFrame, share: float = TELLING, least: int = MIN_SEEDS, text_col: str = "text") -> DataFrame:
    """(word) of which at least `share` of all occurrences in the corpus, and `least` ones, stand within two words of a token.

    `the` stands before some number in any corpus, and nearly always before something else; what introduces identifiers does
    so most of the time. Only words that stand beside tokens are counted, in one pass over the texts.
    """
    beside = found.select(F.explode(F.array(*_neighbours())).alias("word")).where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("beside")).where(F.col("beside") >= least)
    beside = common.materialize(beside, "beside")
    words = texts.select(F.explode(F.split(F.regexp_replace(F.lower(text_col), "[0-9]+", "0"), rf"[{_GAP}]+")).alias("word"))
    total = words.join(beside.select("word"), "word", "left_semi").groupBy("word").agg(F.count("*").alias("total"))
    return common.materialize(beside.join(total, "word").where(F.col("beside") >= share * F.col("total")).select("word"), "telling")


def discover(found: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, telling: DataFrame | None = None) -> DataFrame:
    """Tokens (token, score) of occurrences() that no fixed pattern knows and trusted patterns find; telling: see edges().

    A pattern counts from min_seeds distinct tokens that are seeds, half or whole, or were found before. What stands in it
    and is no seed speaks against it by the share of the token's own patterns that don't count: a number that stands anywhere
    does, a token seen in such contexts only is an open question. A mere number that is no seed always counts against. Confidence is the score in favour over that for and against
    and one more; below half of min_confidence it tells nothing. A token's score is the chance that its prior, the best of its
    one-sided patterns or the best of its two-sided ones is right, as patterns of one side lie within each other; seeds keep 1.
    Tokens found in a round support new patterns in the next one, until scores settle or for `rounds` rounds.
    """
    graph = common.materialize(edges(found, telling).groupBy("pattern", "side", "token").agg(F.max("prior").alias("prior")), "edges")
    priors = graph.where("prior > 0").groupBy("token").agg(F.max("prior").alias("prior"))
    priors = common.materialize(priors.withColumn("score", F.col("prior")), "priors")
    graph = graph.drop("prior")
    # Every exchange costs the driver a stage, a thread and another planning of what is left: a round has few of them.
    score, total = priors, 0.0
    nothing = F.lit(0.0)
    for _ in range(rounds):
        scored = graph.join(score, "token", "left").select("pattern", "token", F.coalesce("score", nothing).alias("score"), F.coalesce("prior", nothing).alias("prior"))
        firm = F.count(F.when((F.col("score") >= min_confidence) | (F.col("prior") > 0), True))
        counting = common.materialize(scored.groupBy("pattern").agg(firm.alias("firm")).where(F.col("firm") >= min_seeds).select("pattern"), "counting").withColumn("counts", F.lit(1.0))
        stray = F.lit(1.0) - F.avg(F.coalesce("counts", nothing))
        tokens = scored.join(counting, "pattern", "left").groupBy("token").agg(stray.alias("stray"), F.max("score").alias("score"), F.max("prior").alias("prior"))
        mere = _mere_number(F.col("token")) & (F.col("prior") < 1)
        for_ = F.sum(F.when(mere, nothing).otherwise(F.col("score")))
        against = F.sum(F.when(mere, F.lit(1.0)).otherwise((F.lit(1.0) - F.col("score")) * F.col("stray")))
        trust = graph.join(counting, "pattern", "left_semi").join(tokens, "token").groupBy("pattern").agg((for_ / (for_ + against + 1)).alias("trust"))
        trust = trust.where(F.col("trust") >= min_confidence / 2)
        told = graph.join(trust, "pattern").select("token", nothing.alias("prior"), *[F.when(F.col("side") == x, F.col("trust")).alias(x) for x in ("one", "both")])
        told = told.unionByName(priors.select("token", "prior"), allowMissingColumns=True).groupBy("token").agg(*[F.max(x).alias(x) for x in ("prior", "one", "both")])
        doubt = sum(F.log1p(-F.least(F.coalesce(x, nothing), F.lit(0.999))) for x in ("one", "both"))
        sure = F.when(F.col("prior") < 1, F.lit(1.0) - (F.lit(1.0) - F.col("prior")) * F.exp(doubt)).otherwise(F.lit(1.0))
        seen = Observation()
        score = common.materialize(told.select("token", "prior", sure.alias("score")).observe(seen, F.sum("score").alias("total")), "scores")
        before, total = total, seen.get.get("total") or 0.0
        if abs(total - before) <= 0.001 * total:
            break
    return score.where((F.col("prior") < 1) & (F.col("score") >= min_confidence)).select("token", "score")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """doc_id, base (array of (start, rank, end, kind) by start, then kind) and more (the same, kind `other`) of every row.

    base: the fixed patterns' valid matches, per kind leftmost and non-overlapping. more: discovered tokens that touch
    no base span. Null and empty texts have none; repeated rows have their own; an empty table gives no rows.
    """
    rows, finds = scan(docs, id_col, text_col)
    rank = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        rank = F.when(F.col("kind") == k, F.lit(i)).otherwise(rank)
    fixed = finds.where(F.col("kind") != "token").where(_is_valid()).select("row", F.struct("start", rank.alias("rank"), "end", "kind").alias("span"))
    found = occurrences(finds)
    other = found.where(~F.col("seed")).join(discover(found, rounds, min_seeds, min_confidence, telling_words(docs, found, text_col=text_col)).select("token"), "token")
    other = other.select("row", F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit("other").alias("kind")).alias("span"))
    spans = fixed.unionByName(other).groupBy(F.col("row").alias("of")).agg(F.array_sort(F.collect_list("span")).alias("spans"))
    out = rows.join(spans, rows["row"] == spans["of"], "left")
    out = out.withColumn("spans", F.coalesce(F.col("spans").cast(SPANS), F.array().cast(SPANS)))
    return out.select("doc_id", F.filter("spans", lambda s: s["rank"] < len(KINDS)).alias("base"), F.filter("spans", lambda s: s["rank"] == len(KINDS)).alias("more"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """find()'s rows as counts by kind, base_sha256 and the spans written out."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "more"))).alias("spans"))


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of its texts replaced by its kind in brackets, all other columns as they were.

    Valid matches of all kinds are found in the text as it was and replaced within the row; of those that overlap the whole
    stretch gives way to the kind of the longest. Discovered tokens are replaced by a join with the rows that have any, by
    doc_id: rows that share one share its tokens. Rows without an id go by their text instead, so that only equal texts among
    them share tokens. Null texts stay null; an empty table stays empty.
    """
    of = common.fresh(docs, "tess_of")
    whose = F.when(F.col(id_col).isNull(), F.concat(F.lit("text "), F.sha2(common.text_of(text_col), 256))).otherwise(F.concat(F.lit("id "), F.col(id_col).cast("string")))
    keyed = docs.withColumn(of, whose)
    rows, finds = scan(keyed, of, text_col)
    found = occurrences(finds)
    known = common.materialize(discover(found, telling=telling_words(docs, found, text_col=text_col)).select("token"), "discovered")
    text = F.col(text_col)
    trigger = "|".join(_TRIGGER.values())
    out = keyed.withColumn(text_col, F.when(text.rlike(trigger), _replaced(text)).otherwise(text))
    if known.isEmpty():
        return out.select(*docs.columns)
    key, gone = common.fresh(docs, "tess_id"), common.fresh(docs, "tess_tokens")
    has = found.where(~F.col("seed")).join(known, "token").join(rows, "row").groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("token").alias(gone))
    has = common.materialize(has, "tokens")
    # Where ids and tokens are few they are sent to the texts; texts move only where they are not.
    size = has.agg(F.coalesce(F.sum(F.length(F.array_join(gone, " ")) + 64), F.lit(0))).first()[0]
    out = out.join(F.broadcast(has) if size <= SENT_BYTES else has, F.col(of) == F.col(key), "left")
    swapped = _swapped(text, TOKEN, lambda m: F.when(F.array_contains(gone, _bare(m)), F.lit("[OTHER]")).otherwise(m))
    return out.withColumn(text_col, F.when(F.col(gone).isNotNull(), swapped).otherwise(text)).select(*docs.columns)


def _valid_spans(text: Column, kind: str) -> Column:
    """Array of (start, end, most: length of the longest match, rank of its kind) of the kind's valid matches in order."""
    pattern, spans = PATTERNS[kind], "array<struct<start:int,end:int,most:int,rank:int>>"
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    # Only valid matches are appended, so that the array isn't made anew for every number of a text.
    none = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        n = F.coalesce(F.char_length(x["m"]), F.lit(0))
        start = acc["at"] + F.char_length(x["g"])
        span = F.struct(start.alias("start"), (start + n).alias("end"), n.alias("most"), F.lit(KINDS.index(kind)).alias("rank"))
        out = F.when(x["m"].isNotNull() & valid(kind, x["m"]), F.concat(acc["out"], F.array(span).cast(spans))).otherwise(acc["out"])
        return F.struct((start + n).alias("at"), out.alias("out"))

    found = F.aggregate(pieces, none, add, lambda acc: acc["out"])
    return F.when(text.rlike(_TRIGGER[kind]), found).otherwise(F.array().cast(spans))


def _replaced(text: Column) -> Column:
    """The text with all kinds' valid matches replaced in one pass."""
    spans = F.array_sort(F.concat(*[_valid_spans(text, k) for k in KINDS]))
    kind = "struct<start:int,end:int,most:int,rank:int>"
    # done: stretches that are closed, each after the text before it; cur: the one that the next span may overlap.
    none = F.struct(F.lit(0).alias("upto"), F.lit("").alias("done"), F.lit(None).cast(kind).alias("cur"))

    def closed(acc: Column) -> Column:
        cur = acc["cur"]
        label = F.concat(F.lit("["), F.upper(F.element_at(F.array(*[F.lit(k) for k in KINDS]), cur["rank"] + 1)), F.lit("]"))
        return F.when(cur.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.substring(text, acc["upto"] + 1, cur["start"] - acc["upto"]), label))

    def add(acc: Column, s: Column) -> Column:
        cur = acc["cur"]
        over = F.coalesce(s["start"] < cur["end"], F.lit(False))
        longer = s["most"] > cur["most"]
        grown = F.struct(cur["start"].alias("start"), F.greatest(cur["end"], s["end"]).alias("end"), F.greatest(cur["most"], s["most"]).alias("most"), F.when(longer, s["rank"]).otherwise(cur["rank"]).alias("rank"))
        upto = F.when(over | cur.isNull(), acc["upto"]).otherwise(cur["end"])
        return F.struct(upto.alias("upto"), F.when(over, acc["done"]).otherwise(closed(acc)).alias("done"), F.when(over, grown.cast(kind)).otherwise(s.cast(kind)).alias("cur"))

    def finish(acc: Column) -> Column:
        end = F.coalesce(acc["cur"]["end"], F.lit(0))
        return F.concat(closed(acc), F.substring(text, end + 1, F.char_length(text)))

    return F.aggregate(spans, none, add, finish)


def _swapped(text: Column, pattern: str, new) -> Column:
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.array_join(F.transform(pieces, lambda x: F.concat(x["g"], F.when(x["m"].isNull(), F.lit("")).otherwise(new(x["m"])))), "")
