"""Rules written as Python functions, called from SQL: a table function over a text, or over the rows of a partition in order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: A rule gets a text and what it kept of the partition's rows before (empty at first), and gives (start, end) of its matches.
Rule = Callable[[str, dict[str, Any]], Iterable[tuple[int, int]]]

FOUND = [StructField("rule", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("match", StringType())]


def by_pattern(pattern: str) -> Rule:
    """The rule that matches wherever the pattern does; classes of characters and bounds of words are ASCII."""
    compiled = re.compile(pattern, re.A)
    return lambda text, kept: (m.span() for m in compiled.finditer(text))


def first_use(pattern: str, opened: str = "(") -> Rule:
    """The rule that matches a term at its first use in a partition, unless that use stands right behind `opened`, as where it is defined."""
    compiled = re.compile(pattern, re.A)

    def rule(text: str, kept: dict[str, Any]) -> Iterable[tuple[int, int]]:
        seen = kept.setdefault("seen", set())
        for m in compiled.finditer(text):
            if m[0] not in seen:
                seen.add(m[0])
                if not text[: m.start()].endswith(opened):
                    yield m.span()

    return rule


def _chosen(rules: Mapping[str, Rule], names: str | None) -> list[str]:
    chosen = sorted(rules) if names is None else [n.strip() for n in names.split(",")]
    if unknown := [n for n in chosen if n not in rules]:
        raise ValueError(f"no rule named {', '.join(unknown)}; there are {', '.join(sorted(rules))}")
    return chosen


def register(spark: SparkSession, name: str, rules: Mapping[str, Rule]) -> None:
    """Registers the table function `name` of two forms; its columns follow from the call:

    - `name(text [, 'rule,rule'])`, beside LATERAL: rule, start, end, match of each match in the text.
    - `name(TABLE(t) PARTITION BY (k) ORDER BY (n) [, 'column' [, 'rule,rule']])`: the same with the other columns of the row. A
      rule keeps what it likes between the rows of a partition, which come in that order, and starts afresh at the next one.

    The column is `text` and all rules run where the call names none; a name that isn't there fails when the query is
    analysed. A null text has no matches. Offsets count characters. A partition is read row by row, never held.
    """
    rules = dict(rules)

    class Rules:
        @staticmethod
        def analyze(source: AnalyzeArgument, first: AnalyzeArgument | None = None, second: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not source.isTable:
                _chosen(rules, first.value if first else None)
                return AnalyzeResult(StructType(FOUND))
            column = first.value if first else "text"
            fields = {f.name: f for f in source.dataType.fields}
            if column not in fields:
                raise ValueError(f"no column named {column}; there are {', '.join(fields)}")
            if clash := [f.name for f in FOUND if f.name in fields and f.name != column]:
                raise ValueError(f"columns {', '.join(clash)} of the table would clash with the function's")
            _chosen(rules, second.value if second else None)
            return AnalyzeResult(StructType([*(f for n, f in fields.items() if n != column), *FOUND]))

        def __init__(self) -> None:
            self.kept: dict[str, dict[str, Any]] = {}

        def eval(self, source: Any, first: str | None = None, second: str | None = None):
            whole_row = hasattr(source, "__fields__")
            if whole_row:
                values = source.asDict(recursive=False)
                text = values.pop(first or "text")
                head, names = tuple(values.values()), _chosen(rules, second)
            else:
                text, head, names = source, (), _chosen(rules, first)
            for n in names if text is not None else ():
                for start, end in rules[n](text, self.kept.setdefault(n, {}) if whole_row else {}):
                    yield (*head, n, start, end, text[start:end])

        def terminate(self):
            self.kept = {}
            return iter(())

    spark.udtf.register(name, udtf(Rules))
