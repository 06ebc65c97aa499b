"""An audit as three steps over whole tables of files: parse, validate, report; scores and criteria that every audit shares."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.labels import lookup
from tessella.operators import codes
from tessella.operators.issues import SEVERITY_POINTS as WEIGHTS

#: Criteria of the levels AAA and AA; all others are of level A.
LEVEL_AAA = ["1.2.6", "1.2.7", "1.2.8", "1.2.9", "1.4.6", "1.4.7", "2.1.3", "2.2.3", "2.2.4", "2.2.5", "2.3.2", "2.4.8", "2.4.9", "2.4.10", "2.5.5", "3.1.3", "3.1.4", "3.1.5", "3.1.6", "3.2.5", "3.3.5", "3.3.6"]
LEVEL_AA = ["1.2.4", "1.2.5", "1.4.3", "1.4.4", "1.4.5", "2.4.5", "2.4.6", "2.4.7", "3.1.2", "3.2.4", "3.3.3", "3.3.4"]


def level_and_principle(criteria: Column) -> tuple[Column, Column]:
    """(level, principle) of an array of criteria: the level of the first that is AAA or AA, else A; the principle of the first
    criterion by its digit, Perceivable where there is none."""
    first = F.left(F.get(criteria, F.lit(0)), F.lit(1))
    return codes.criterion_level(criteria, LEVEL_AAA, LEVEL_AA), F.coalesce(lookup(first, codes.PRINCIPLES), F.lit("Perceivable"))


def criteria_of(issues: DataFrame, key: list[str]) -> DataFrame:
    """key, code, criteria, level, principle of the issues that name criteria; the others have no row."""
    level, principle = level_and_principle(F.col("criteria"))
    return issues.where(F.size("criteria") > 0).select(*key, "code", "criteria", level.alias("level"), principle.alias("principle"))


def scores(files: DataFrame, issues: DataFrame, key: list[str], times: Column | None = None) -> DataFrame:
    """key, a count for each severity, deduction, score (100 less the deduction, 0 at least) of every file, 100 without issues.

    times: how often a row's issue occurs, once by default. Severities other than the four take no points. Counts are
    formed by file before they meet the files, so no file's issues are held.
    """
    n = F.lit(1) if times is None else times
    counts = issues.groupBy(*key).agg(*[F.sum(F.when(F.col("severity") == s, n).otherwise(0)).alias(f"n_{s}") for s in WEIGHTS])
    out = files.select(*key).join(counts, key, "left").fillna(0, [f"n_{s}" for s in WEIGHTS])
    deduction = sum((F.col(f"n_{s}") * w for s, w in WEIGHTS.items()), F.lit(0))
    return out.withColumn("deduction", deduction).withColumn("score", F.greatest(F.lit(0), 100 - F.col("deduction")))


class Audit(ABC):
    """The template: run() is report(validate(parse(files))), each step a DataFrame that Spark plans as one query.

    A kind of audit says how files are parsed and which issues (key, code, severity, criteria, n: how often) the parsed
    files have. The report is the same for all: a row for each file, those without issues included. An issue whose severity
    is null or unknown is listed but takes no points; a file whose text is null is judged as an empty one.
    """

    def __init__(self, *key: str):
        self.key = list(key)

    @abstractmethod
    def parse(self, files: DataFrame) -> DataFrame:
        """The key and what the checks look at, a row for each file."""

    @abstractmethod
    def validate(self, parsed: DataFrame) -> DataFrame:
        """key, code, severity, criteria (array of strings), n."""

    def report(self, parsed: DataFrame, issues: DataFrame) -> DataFrame:
        """key, counts by severity, deduction, score, n_issues, codes (sorted, comma-joined), level (the highest named), passed (no critical and no serious issue)."""
        level, _ = level_and_principle(F.col("criteria"))
        listed = issues.groupBy(*self.key).agg(F.sum("n").alias("n_issues"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"), F.max(F.when(F.size("criteria") > 0, level)).alias("level"))
        scored = scores(parsed, issues, self.key, F.col("n"))
        out = scored.join(listed, self.key, "left").fillna(0, ["n_issues"]).fillna("", ["codes"])
        return out.withColumn("passed", (F.col("n_critical") == 0) & (F.col("n_serious") == 0))

    def run(self, files: DataFrame) -> DataFrame:
        parsed = self.parse(files)
        return self.report(parsed, self.validate(parsed))


class PageAudit(Audit):
    """Pages of markup: language, empty links, images without alternative text, headings, landmark."""

    #: Criteria that the codes stand for.
    CRITERIA = {"EPUB-SEM-001": ["3.1.1"], "EPUB-SEM-002": ["2.4.4"], "EPUB-IMG-001": ["1.1.1"], "EPUB-STRUCT-002": ["1.3.1"], "EPUB-STRUCT-003": ["1.3.1", "2.4.6"]}

    def __init__(self, *key: str, html: str = "html"):
        super().__init__(*key)
        self.html = html

    def parse(self, files: DataFrame) -> DataFrame:
        return files.select(*self.key, F.coalesce(F.col(self.html), F.lit("")).alias("html"))

    def validate(self, parsed: DataFrame) -> DataFrame:
        from tessella.operators.documents import audit_pages

        one = F.struct(*self.key).alias("_key")
        found = audit_pages(parsed.select(one, "html"), "_key", "html").select("_key.*", "code", "severity", F.col("n").cast("long").alias("n"))
        criteria = F.array().cast("array<string>")
        for code, named in self.CRITERIA.items():
            criteria = F.when(F.col("code") == code, F.array(*[F.lit(c) for c in named])).otherwise(criteria)
        return found.withColumn("criteria", criteria)
