"""Citations and references: sequence, cross-references, order, renumbering, grouping, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import citation_numbers
from tessella.operators.relational import numbers_between


def exploded(citations: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """key, order, place, number: each number of each citation, in order of appearance."""
    return citations.select(key, order, F.posexplode(citation_numbers(F.col(text))).alias("place", "number"))


def sequence_issues(numbers: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, kind, number: missing between the smallest and largest, reused, and out of order by first appearance."""
    once = numbers.groupBy(key, "number").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("at"))
    following = F.lead("number").over(Window.partitionBy(key).orderBy("number"))
    highest = F.max("number").over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    once = once.withColumn("following", following).withColumn("before", highest)

    number = F.col("number")
    kind = numbers.schema["number"].dataType
    missing = numbers_between(once.where(F.col("following") > number + 1).select(key, "number", "following"), number + 1, F.col("following") - 1, "_missing")
    missing = missing.select(key, F.lit("missing").alias("kind"), F.col("_missing").cast(kind).alias("number"))
    kinds = F.filter(F.array(F.when(F.col("n") > 1, "reused"), F.when(number < F.col("before"), "out-of-order")), lambda k: k.isNotNull())
    return missing.unionByName(once.select(key, F.explode(kinds).alias("kind"), "number"))


def gaps(numbers: DataFrame, key: str) -> DataFrame:
    """key, after, before of each stretch that no citation has."""
    d = numbers.select(key, "number").distinct()
    nxt = F.lead("number").over(Window.partitionBy(key).orderBy("number"))
    return d.withColumn("before", nxt).where(F.col("before") - F.col("number") > 1).select(key, F.col("number").alias("after"), "before")


def cross_references(numbers: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """key, kind, number: citations without a reference, references without a citation, and matched numbers."""
    cited, listed = numbers.select(key, "number").distinct(), references.select(key, "number").distinct()
    parts = [(cited.join(listed, [key, "number"], "left_anti"), "no-reference"), (listed.join(cited, [key, "number"], "left_anti"), "not-cited"), (cited.join(listed, [key, "number"], "left_semi"), "matched")]
    out = None
    for part, kind in parts:
        part = part.select(key, F.lit(kind).alias("kind"), "number")
        out = part if out is None else out.unionByName(part)
    return out


def by_appearance(references: DataFrame, numbers: DataFrame, key: str, order: list[str]) -> DataFrame:
    """references + new_number: in order of first citation; those never cited follow by their old numbers."""
    first = numbers.groupBy(key, "number").agg(F.min(F.struct(*order)).alias("_at"))
    return references.join(first, [key, "number"], "left").withColumn("new_number", F.row_number().over(Window.partitionBy(key).orderBy(F.col("_at").isNull(), "_at", "number"))).drop("_at")


def by_author(references: DataFrame, key: str) -> DataFrame:
    """references + new_number by first author (binary order of lower case; no author first), then old number."""
    return references.withColumn("new_number", F.row_number().over(Window.partitionBy(key).orderBy(F.lower(F.coalesce("author", F.lit(""))), "number")))


def by_year(references: DataFrame, key: str, newest: bool = False) -> DataFrame:
    """references + new_number by year; no year counts as 0."""
    year = F.coalesce("year", F.lit(0))
    return references.withColumn("new_number", F.row_number().over(Window.partitionBy(key).orderBy(year.desc() if newest else year.asc(), "number")))


def sort_key(last: Column, year: Column, title: Column) -> Column:
    return F.lower(F.concat_ws("_", F.coalesce(last, F.lit("")), F.coalesce(year.cast("string"), F.lit("")), F.left(F.coalesce(title, F.lit("")), F.lit(20))))


def move(references: DataFrame, key: str, old: int, new: int) -> DataFrame:
    """references + new_number: the one at `old` goes to `new`, those between close up."""
    n = F.col("number")
    shifted = F.when(n == old, new).when((n > old) & (n <= new), n - 1).when((n < old) & (n >= new), n + 1).otherwise(n)
    return references.withColumn("new_number", shifted)


def grouped(references: DataFrame) -> DataFrame:
    """sort key, members of references that are the same work."""
    return references.groupBy(sort_key(F.col("author"), F.col("year"), F.col("title")).alias("work")).agg(F.count("*").alias("n"), F.min("ref_id").alias("first"))


def formatted(authors: Column, year: Column, title: Column, source: Column, style: str = "apa") -> Column:
    """A reference in a style: apa, mla, chicago or vancouver; missing parts leave no marks."""
    y = year.cast("string")
    if style == "mla":
        parts = (F.concat(authors, F.lit(".")), F.concat(F.lit('"'), title, F.lit('."')), F.concat(source, F.lit(",")), F.concat(y, F.lit(".")))
    elif style == "vancouver":
        parts = (F.concat(authors, F.lit(".")), F.concat(title, F.lit(".")), F.concat(source, F.lit(".")), F.concat(y, F.lit(".")))
    elif style == "chicago":
        parts = (F.concat(authors, F.lit(".")), F.concat(y, F.lit(".")), F.concat(F.lit('"'), title, F.lit('."')), F.concat(source, F.lit(".")))
    else:
        parts = (authors, F.concat(F.lit("("), y, F.lit(").")), F.concat(title, F.lit(".")), F.concat(source, F.lit(".")))
    return F.concat_ws(" ", *parts)


def orphaned(numbers: Column, kind: Column) -> Column:
    """Whether a numeric citation names no number."""
    return kind.isin("NUMERIC", "SUPERSCRIPT", "BRACKET") & (F.size(numbers) == 0)


def strict_numbers(text: Column) -> Column:
    """Numbers of one to three digits in brackets, else in parentheses, else alone; one range under 50 long is written out, else a list's leading numbers."""
    body = r"(\d{1,3}(?:\s*[-–,]\s*\d{1,3})*)"
    inner = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for t, p in ((text, rf"\[{body}\]"), (text, rf"\({body}\)"), (F.trim(text), rf"^{body}$"))], F.lit(""))
    ends = F.transform(F.split(inner, r"\s*[-–]\s*"), lambda x: F.regexp_extract(x, r"^\s*(\d+)", 1).try_cast("int"))
    lo, hi = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
    parts = F.transform(F.split(inner, r"\s*,\s*"), lambda x: F.regexp_extract(x, r"^\s*(\d+)", 1).try_cast("int"))
    return F.when((F.size(ends) == 2) & (hi >= lo) & (hi - lo < 50), F.sequence(lo, F.greatest(lo, hi))).otherwise(F.filter(parts, lambda n: n.isNotNull()))


def reference_entries(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, number, entry of a text's reference section: numbered entries where there are three or more, else its paragraphs."""
    head = r"(?:^|\n)[ \t]*(?:References|Bibliography|Works\s+Cited|Literature\s+Cited)[ \t]*\n"
    tail = r"\n[ \t]*(?:Appendix|Acknowledgments?|About\s+the\s+Author|Notes)[ \t]*\n"
    rest = F.element_at(F.split(F.col(text), f"(?i){head}", 2), -1)
    section = F.when(F.col(text).rlike(f"(?i){head}"), F.get(F.split(rest, f"(?i){tail}", 2), F.lit(0)))

    def one_line(t: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\n\s+", " ")

    numbered = F.filter(F.split(section, r"(?:^|\n)\s*(?=\d{1,4}[.)]\s)"), lambda t: t.rlike(r"^\s*\d{1,4}[.)]\s+"))
    numbered = F.filter(F.transform(numbered, lambda t: F.struct(F.regexp_extract(t, r"^\s*(\d{1,4})", 1).try_cast("int").alias("number"), one_line(F.get(F.split(F.regexp_replace(t, r"^\s*\d{1,4}[.)]\s+", ""), r"\n\s*\n"), F.lit(0))).alias("entry"))), lambda e: F.char_length(e["entry"]) > 10)
    plain = F.filter(F.transform(F.split(section, r"\n{2,}|\n(?=[A-Z])"), one_line), lambda t: F.char_length(t) > 15)
    plain = F.transform(plain, lambda t, i: F.struct(F.coalesce(F.regexp_extract(t, r"^(\d{1,4})[.)]\s+", 1).try_cast("int"), i + 1).alias("number"), t.alias("entry")))
    return docs.select(key, F.posexplode(F.when(F.size(numbered) >= 3, numbered).otherwise(plain)).alias("place", "e")).select(key, "place", "e.*")
