"""Codes and reports of audits: categories, precedence, criteria, summaries, nested reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.labels import lookup
from tessella.functions.numbers import pct

#: Principles by the first digit of a criterion.
PRINCIPLES = {"1": "Perceivable", "2": "Operable", "3": "Understandable", "4": "Robust"}
_ISSUES = "array<struct<code:string,severity:string,message:string>>"


def category(code: Column, message: Column, exact: dict[str, str], prefix: dict[str, str], words: dict[str, str], other: str = "other") -> Column:
    """The exact code's category, else that of its longest prefix, else that of the first word in the message."""
    out = lookup(code, exact) if len(exact) > 2 else F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in exact.items()])
    longest = [F.when(code.startswith(k), F.lit(v)) for k, v in sorted(prefix.items(), key=lambda kv: -len(kv[0]))]
    return F.coalesce(out, *longest, *[F.when(F.lower(message).contains(k), F.lit(v)) for k, v in words.items()], F.lit(other))


def triage(issues: DataFrame, existing: Column, toc: Column, artifact: Column, in_list: Column) -> DataFrame:
    """issues + disposition: what is known already, then contents, artifacts, lists, else manual."""
    return issues.withColumn("disposition", F.when(existing, "existing").when(toc, "toc").when(artifact, "artifact").when(in_list, "list").otherwise("manual"))


def change_summary(changes: DataFrame, key: Column) -> DataFrame:
    """Counts by status; reverted changes count as rejected."""
    s = F.col("status")
    return changes.groupBy(key).agg(F.count("*").alias("total"), F.count_if(s == "APPLIED").alias("applied"), F.count_if(s.isin("REJECTED", "REVERTED")).alias("rejected"), F.count_if(s == "PENDING").alias("pending"))


def criterion_status(issues: DataFrame, rules: DataFrame, fixed: Column) -> DataFrame:
    """criterion, n, fixed, status: Supports where all are fixed, Does Not Support with an open critical one, else partially."""
    j = issues.withColumn("_fixed", fixed).join(F.broadcast(rules), "code")
    open_ = ~F.col("_fixed")
    status = F.when(F.count_if(open_) == 0, "Supports").when(F.count_if(open_ & (F.col("severity") == "critical")) > 0, "Does Not Support").otherwise("Partially Supports")
    return j.groupBy("criterion").agg(F.count("*").alias("n"), F.count_if(F.col("_fixed")).alias("fixed"), status.alias("status"))


def filter_in(df: DataFrame, **values) -> DataFrame:
    """Rows whose column is in the list given for it; None means no filter."""
    for k, v in values.items():
        if v is not None:
            df = df.where(F.col(k).isin(*v))
    return df


def quantities(rows: DataFrame) -> DataFrame:
    """rows + failed (total less passed) and pass_rate (1 decimal)."""
    return rows.withColumn("failed", F.col("total") - F.col("passed")).withColumn("pass_rate", pct(F.col("passed"), F.col("total"), 1))


def principle(criterion: Column) -> Column:
    return lookup(F.left(criterion, F.lit(1)), PRINCIPLES)


def criterion_level(criteria: Column, aaa: list[str], aa: list[str]) -> Column:
    """AAA or AA by the first criterion of the array that is in a list, else A."""
    level = F.transform(criteria, lambda c: F.when(c.isin(*aaa), "AAA").when(c.isin(*aa), "AA"))
    return F.coalesce(F.get(F.filter(level, lambda x: x.isNotNull()), F.lit(0)), F.lit("A"))


def remark_check(required: Column, remark: Column, least: int, words: list[str]) -> Column:
    """ok, too short, or no detail where none of the words occurs; ok where none is required."""
    some = F.lit(False)
    for w in words:
        some = some | remark.contains(w)
    return F.when(~required, "ok").when(F.char_length(F.coalesce(remark, F.lit(""))) < least, "too short").when(~some, "no detail").otherwise("ok")


def confidence_label(value: Column, high: float, medium: float) -> Column:
    return F.when(value >= high, "High").when(value >= medium, "Medium").otherwise("Low")


def first_issue_array(report: Column) -> Column:
    """The first of combinedIssues, issues and violations that a JSON report has."""
    return F.coalesce(*[F.from_json(F.get_json_object(report, f"$.{k}"), _ISSUES) for k in ("combinedIssues", "issues", "violations")])


def flatten_report(reports: DataFrame, key: str, column: str) -> DataFrame:
    """key, assertion, code of a report of assertions that hold assertions."""
    kind = "array<struct<assertions:array<struct<id:string,code:string>>>>"
    outer = reports.select(key, F.explode(F.from_json(F.get_json_object(column, "$.assertions"), kind)).alias("o"))
    return outer.select(key, F.explode("o.assertions").alias("i")).select(key, F.col("i.id").alias("assertion"), F.col("i.code").alias("code"))
