"""Issues of audits: scores, duplicates, clusters, comparisons, criteria, tallies, conformance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.numbers import half_up, pct, rate
from tessella.operators.kernels import keep_rows

#: Points off for an issue, and weights of rules.
SEVERITY_POINTS = {"critical": 15, "serious": 8, "moderate": 4, "minor": 1}
RULE_WEIGHTS = {"error": 10, "warning": 3, "info": 1}
SEVERITY_RANK = {"critical": 0, "serious": 1, "moderate": 2, "minor": 3}


def _by(column: Column, values: dict[str, int], other=0) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def scores(issues: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score: 100 less the points of all issues, 0 at least; counts by severity."""
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITY_POINTS]
    return issues.groupBy(*keys).agg(F.greatest(F.lit(0), F.lit(100) - F.sum(_by(F.col("severity"), SEVERITY_POINTS))).alias("score"), *counts)


def pass_scores(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score (weighted share of passed rules, 2 decimals), level; results: passed, severity as error, warning or info."""
    weight = _by(F.col("rule_severity"), RULE_WEIGHTS)
    out = results.groupBy(*keys).agg(pct(F.sum(F.when(F.col("passed"), weight).otherwise(0)), F.sum(weight), 2, empty=100.0).alias("score"))
    return out.withColumn("level", F.when(F.col("score") >= 95, "excellent").when(F.col("score") >= 80, "good").when(F.col("score") >= 60, "fair").otherwise("poor"))


def pass_rate_conformance(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pass_rate (1 decimal), conformance: supports at 100, partially from 25 on, else not."""
    out = results.groupBy(*keys).agg(pct(F.count_if(F.col("passed")), F.count("*"), 1).alias("pass_rate"))
    return out.withColumn("conformance", F.when(F.col("pass_rate") >= 100, "Supports").when(F.col("pass_rate") >= 25, "Partially Supports").otherwise("Does Not Support"))


def batch_conformance(details: DataFrame, key: str, strategy: str = "conservative") -> DataFrame:
    """conservative: the worst of all documents; optimistic: Supports where half or more do. details: key, conformance."""
    c = F.col("conformance")
    if strategy == "optimistic":
        level = F.when(F.count_if(c == "Supports") * 2 >= F.count("*"), "Supports").when(F.bool_or(c != "Does Not Support"), "Partially Supports").otherwise("Does Not Support")
    else:
        level = F.when(F.bool_or(c == "Does Not Support"), "Does Not Support").when(F.bool_or(c == "Partially Supports"), "Partially Supports").otherwise("Supports")
    return details.groupBy(key).agg(level.alias("conformance"))


def first_of_key(issues: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One issue of each key, the first in order; nulls in keys are a value like any other."""
    return issues.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def clusters(issues: DataFrame, code: str, file: str, order: str, examples: int = 3) -> DataFrame:
    """code, files (distinct), instances, severity and message of the first, the first examples joined by |.

    Only the first rows of each code are gathered; counts are partial sums.
    """
    counted = issues.groupBy(code).agg(F.countDistinct(file).alias("files"), F.count("*").alias("instances"))
    nth = F.row_number().over(Window.partitionBy(code).orderBy(order))
    head = issues.withColumn("_n", nth).where(F.col("_n") <= examples)
    head = head.groupBy(code).agg(F.min_by("severity", "_n").alias("severity"), F.min_by("message", "_n").alias("message"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "message"))), lambda x: x["message"]), "|").alias("examples"))
    return counted.join(head, code)


def worst_of(rows: DataFrame, key: str, status: str, rank: dict[str, int]) -> DataFrame:
    """key, the status of the lowest rank, n."""
    return rows.groupBy(key).agg(F.min_by(status, _by(F.col(status), rank, 99)).alias("worst"), F.count("*").alias("n"))


def compare_audits(before: DataFrame, after: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, status, n: each old issue takes one new issue of its code and place, then of its code and severity.

    Taken: remaining. Old ones left: resolved; new ones left: regression. Both rounds pair equals by rank, so that
    n-th meets n-th; what the first round pairs is out of the second.
    """
    first = [*keys, "code", "location"]
    second = [*keys, "code", "severity"]

    def ranked(df: DataFrame, by: list[str]) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order)))

    def held(df: DataFrame, other: DataFrame, by: list[str], how: str) -> DataFrame:
        # Issues without a place are alike in place.
        mine, theirs = ranked(df, by), ranked(other, by).select(*[F.col(c).alias(f"_{c}") for c in [*by, "_n"]])
        same = [mine[c].eqNullSafe(theirs[f"_{c}"]) for c in [*by, "_n"]]
        return mine.join(theirs, reduce(Column.__and__, same), how).drop("_n")

    def rest(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
        return held(df, other, by, "left_anti")

    def common(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
        return held(df, other, by, "left_semi")

    old2, new2 = rest(before, after, first), rest(after, before, first)
    parts = [common(before, after, first).withColumn("status", F.lit("remaining")), common(old2, new2, second).withColumn("status", F.lit("remaining")), rest(old2, new2, second).withColumn("status", F.lit("resolved")), rest(new2, old2, second).withColumn("status", F.lit("regression"))]
    names = [*keys, "severity", "status"]
    out = parts[0].select(*names)
    for p in parts[1:]:
        out = out.unionByName(p.select(*names))
    return out


def reaudit_metrics(compared: DataFrame, keys: list[str]) -> DataFrame:
    resolved, remaining = F.count_if(F.col("status") == "resolved"), F.count_if(F.col("status") == "remaining")
    return compared.groupBy(*keys).agg(resolved.alias("resolved"), remaining.alias("remaining"), F.count_if(F.col("status") == "regression").alias("regressions"), pct(resolved, resolved + remaining, 2).alias("resolution_rate"), F.count_if((F.col("status") == "resolved") & (F.col("severity") == "critical")).alias("critical_resolved"))


def same_location(page_a: Column, page_b: Column, loc_a: Column, loc_b: Column) -> Column:
    """By page where both have one, else by text."""
    return F.when(page_a.isNotNull() & page_b.isNotNull(), page_a == page_b).otherwise(F.coalesce(loc_a == loc_b, F.lit(False)))


def instance_key(*parts: Column) -> Column:
    """SHA-256 of the parts as a JSON array."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def per_criterion(issues: DataFrame, rules: DataFrame) -> DataFrame:
    """criterion, n issues, distinct codes: issues times the criteria of their rule; rules is a small table of (code, criterion)."""
    return issues.join(F.broadcast(rules), "code").groupBy("criterion").agg(F.count("*").alias("n_issues"), F.countDistinct("code").alias("n_codes"))


def tally(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by source and severity with a check that both sum to the total."""
    sources = [F.count_if(F.col("source_no") == i).alias(f"source_{i}") for i in range(3)]
    severities = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITY_POINTS]
    out = issues.groupBy(*keys).agg(F.count("*").alias("total"), *sources, *severities)
    return out.withColumn("consistent", (F.col("source_0") + F.col("source_1") + F.col("source_2") == F.col("total")) & (F.col("n_critical") + F.col("n_serious") + F.col("n_moderate") + F.col("n_minor") == F.col("total")))


def tally_change(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Difference of two stages' totals by key."""
    x = a.select(*keys, F.col("total").alias("before"))
    return x.join(b.select(*keys, F.col("total").alias("after")), keys, "full_outer").fillna(0, ["before", "after"]).withColumn("lost", F.col("before") - F.col("after"))


def resolutions(before: DataFrame, after: DataFrame, modified: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status: fixed if gone, failed if still there though modified, else pending."""
    there = after.select(*keys).distinct().withColumn("_there", F.lit(True))
    touched = modified.select(*keys).distinct().withColumn("_touched", F.lit(True))
    both = before.select(*keys).distinct().join(there, keys, "left").join(touched, keys, "left")
    return both.select(*keys, F.when(F.col("_there").isNull(), "fixed").when(F.col("_touched"), "failed").otherwise("pending").alias("status"))


def similar_groups(issues: DataFrame, least: int = 3) -> DataFrame:
    """Issues by fix, else code; batchable from `least` on."""
    return issues.groupBy(F.coalesce("fix", "code").alias("group_key")).agg(F.count("*").alias("n"), (F.count("*") >= least).alias("batchable"))


def plan_progress(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """completed share (whole per cent), critical ones left, minutes: five for each manual task left."""
    done = F.col("status") == "completed"
    return tasks.groupBy(*keys).agg(F.count("*").alias("total"), half_up(rate(F.count_if(done) * 100.0, F.count("*"))).alias("completed_pct"), F.count_if(~done & (F.col("severity") == "critical")).alias("critical_left"), (F.count_if(~done & ~F.col("auto")) * 5).alias("minutes_left"))


def condition_status(conditions: DataFrame, failures: DataFrame) -> DataFrame:
    """condition, status: H for human ones, -- where not applicable, FAIL with failures, PASS where tested, else UNTESTED."""
    n = failures.groupBy("condition").agg(F.count("*").alias("n_failures"))
    out = conditions.join(n, "condition", "left").fillna(0, ["n_failures"])
    return out.withColumn("status", F.when(~F.col("applicable"), "--").when(F.col("n_failures") > 0, "FAIL").when(F.col("human"), "H").when(F.col("tested"), "PASS").otherwise("UNTESTED"))


def checkpoint_rollup(statuses: DataFrame) -> DataFrame:
    """checkpoint, status: FAIL over UNTESTED over all-human over PASS."""
    s = F.col("status")
    return statuses.groupBy("checkpoint").agg(F.when(F.bool_or(s == "FAIL"), "FAIL").when(F.bool_or(s == "UNTESTED"), "UNTESTED").when(F.bool_and(s.isin("H", "--")), "H").otherwise("PASS").alias("status"))


def standard_mapping(results: DataFrame, mapping: DataFrame) -> DataFrame:
    """clause, status and n of the criteria mapped to it; results: criterion, conformance; mapping: a small table."""
    c = F.col("conformance")
    joined = results.join(F.broadcast(mapping), "criterion")
    return joined.groupBy("clause").agg(F.count("*").alias("n"), F.when(F.bool_and(c == "Supports"), "Supports").when(F.bool_and(c == "Does Not Support"), "Does Not Support").otherwise("Partially Supports").alias("status"))


def overall_compliance(statuses: DataFrame) -> DataFrame:
    """Mean of 100, 50 and 0, whole; not applicable ones don't count."""
    points = F.when(F.col("status") == "Supports", 100.0).when(F.col("status") == "Partially Supports", 50.0).when(F.col("status") == "Does Not Support", 0.0)
    return statuses.agg(half_up(F.coalesce(F.avg(points), F.lit(0.0))).alias("overall"), F.count(points).alias("n"))


def verification_queue(results: DataFrame, issues: DataFrame) -> DataFrame:
    """Criteria of results or issues with their worst severity and lowest confidence, most severe and least sure first."""
    a = results.select("criterion", F.lit(99).alias("sev"), "confidence_rank")
    b = issues.select("criterion", _by(F.col("severity"), SEVERITY_RANK, 99).alias("sev"), F.lit(99).alias("confidence_rank"))
    return a.unionByName(b).groupBy("criterion").agg(F.min("sev").alias("severity_rank"), F.min("confidence_rank").alias("confidence_rank")).orderBy("severity_rank", "confidence_rank", "criterion")


def three_tier_dedup(matches: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows that stay, of columns rule, start, end, match and any others: not one whose rule and span, or span, or text over ten
    characters a kept row has.

    A dropped row suppresses nothing, so rows are walked in order, per document. A null is equal to a null; a null text
    suppresses nothing.
    """

    def walk(g: dict[str, list]) -> list[bool]:
        spans, texts, keep = set(), set(), []
        for span, text in zip(zip(g["start"], g["end"], strict=True), g["match"], strict=True):
            long = text is not None and len(text) > 10
            stays = span not in spans and not (long and text in texts)
            keep.append(stays)
            if stays:
                spans.add(span)
                texts.update([text] if long else [])
        return keep

    return keep_rows(matches, keys, order, ["start", "end", "match"], walk)


def collapse_contents(issues: DataFrame, is_contents: Column, keys: list[str], page: str) -> DataFrame:
    """Issues of contents pages as one row a page with how many it stands for; others as they are, 0."""
    flagged = issues.withColumn("_toc", is_contents)
    one = flagged.where("_toc").groupBy(*keys, page).agg(F.count("*").alias("suppressed")).withColumn("code", F.lit("TOC"))
    rest = flagged.where(~F.col("_toc")).select(*keys, page, F.lit(0).cast("long").alias("suppressed"), "code")
    return rest.unionByName(one)
