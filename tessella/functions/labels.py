"""Labels of page regions: canonical names, final labels, verifiers, buckets."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classes that accuracy is measured over, in report order.
CANONICAL = ("paragraph", "section-header", "table", "figure", "caption", "footnote", "header", "footer", "list-item", "toci", "formula")

#: Labels that reviewers and detectors write, and what they mean.
SYNONYMS = {
    "p": "paragraph", "text": "paragraph", "h1": "section-header", "h2": "section-header", "h3": "section-header", "h4": "section-header", "h5": "section-header", "h6": "section-header",
    "heading": "section-header", "title": "section-header", "picture": "figure", "image": "figure", "fig": "figure", "tbl": "table", "li": "list-item", "list": "list-item", "cap": "caption",
    "fn": "footnote", "hdr": "header", "page-header": "header", "ftr": "footer", "page-footer": "footer", "toc": "toci", "equation": "formula",
}


def lookup(key: Column, values: dict[str, str]) -> Column:
    """values[key], null for other keys; a literal map, so no join."""
    return F.get(F.filter(F.array(*[F.when(key == k, F.lit(v)) for k, v in values.items()]), lambda x: x.isNotNull()), F.lit(0)) if len(values) < 3 else F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*values.items())]), key)


def canonical(label: Column) -> Column:
    """The canonical class of a label; null if unknown."""
    clean = F.regexp_replace(F.lower(F.trim(label)), r"[_\s]+", "-")
    return F.when(clean.isin(*CANONICAL), clean).otherwise(lookup(clean, SYNONYMS))


def heading_level(label: Column) -> Column:
    return F.regexp_extract(F.lower(label), "^h([1-6])$", 1).try_cast("int")


def by_machine(verified_by: Column) -> Column:
    """Written by a pipeline, not a reviewer: `auto-annotation` or a name that starts with ai:."""
    return F.coalesce((verified_by == "auto-annotation") | verified_by.startswith("ai:"), F.lit(False))


def final_label(decision: Column, kind: Column, chosen: Column) -> Column:
    """The type where confirmed, the reviewer's label (else the type) where corrected, else null."""
    return F.when(decision == "CONFIRMED", kind).when(decision == "CORRECTED", F.coalesce(chosen, kind))


def human_final_label(decision: Column, kind: Column, chosen: Column, verified_by: Column) -> Column:
    return F.when(~by_machine(verified_by), final_label(decision, kind, chosen))


def effective_label(decision: Column, label: Column) -> Column:
    """Rejections as a label of their own, for agreement beyond chance."""
    return F.when(decision == "REJECTED", F.lit("__REJECTED__")).otherwise(label)


#: Uneven bins of confidence, upper ends exclusive.
CONFIDENCE_BINS = (("0.00-0.50", 0.0, 0.5), ("0.50-0.70", 0.5, 0.7), ("0.70-0.80", 0.7, 0.8), ("0.80-0.90", 0.8, 0.9), ("0.90-0.95", 0.9, 0.95), ("0.95-1.00", 0.95, 1.01))


def confidence_bin(confidence: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, low, high in CONFIDENCE_BINS:
        out = F.when((confidence >= low) & (confidence < high), F.lit(name)).otherwise(out)
    return out
