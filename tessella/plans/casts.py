"""Columns whose type DuckDB widens or narrows: the SQL casts them to the type that the query gives."""

from __future__ import annotations

#: query -> column -> type
CASTS: dict[str, dict[str, str]] = {
    "af2_array_tests": {"n_long": "INTEGER"},
    "ag13_grouped_accuracy": {"agree": "BIGINT"},
    "ag23_issues_by_category": {"pages": "BIGINT"},
    "ag25_timesheet_totals": {"zones_reviewed": "BIGINT"},
    "ag26_per_operator": {"zones_reviewed": "BIGINT"},
    "ag26b_per_title": {"zones_reviewed": "BIGINT"},
    "ag27_seconds_per_type": {"total_zones": "BIGINT"},
    "ag28_operator_null_rates": {"active_ms": "BIGINT", "reviewed": "BIGINT"},
    "ag37_kpi_report": {"p50_ms": "DOUBLE", "p90_ms": "DOUBLE"},
    "ag4_sum": {"total": "BIGINT"},
    "ag5_max_and_sum": {"total": "BIGINT"},
    "jn13_cross_references": {"number": "INTEGER"},
    "jn15_point_in_interval": {"chunk": "INTEGER"},
    "jn22_ordered_join": {"place": "INTEGER"},
    "jn5_group_kept_without_match": {"keys": "BIGINT"},
    "lx14_proximity_clusters": {"cluster": "BIGINT"},
    "lx16_nearest_heading_level": {"level": "INTEGER"},
    "lx4_blocks": {"block": "BIGINT"},
    "lx8_word_counts": {"n_words": "INTEGER", "n_chars": "INTEGER"},
    "lx9_columns": {"column": "BIGINT"},
    "mf5_percentiles": {"p50": "DOUBLE", "p90": "DOUBLE"},
    "re5_page_audit": {"n": "INTEGER"},
    "sf1_tokenise": {"n_tokens": "INTEGER"},
    "sf8_html_to_text": {"n": "INTEGER"},
    "sf9_entities": {"shorter": "INTEGER"},
    "st10_sorted_matches": {"spot": "INTEGER"},
    "st6_dotted_numbers": {"place": "INTEGER"},
    "st7_by_author": {"new_number": "INTEGER"},
    "st7b_by_year": {"new_number": "INTEGER"},
    "wn10_heading_skips": {"headings": "INTEGER"},
    "wn11_heading_report": {"headings": "INTEGER", "empty": "INTEGER", "first_level": "INTEGER"},
    "wn13_sequence_issues": {"number": "INTEGER"},
    "wn13b_gaps": {"after": "INTEGER", "before": "INTEGER"},
    "wn14_by_appearance": {"number": "INTEGER", "new_number": "INTEGER"},
    "wn16_next_numbers": {"number": "INTEGER"},
    "wn19_daily_trend": {"reviewed": "BIGINT"},
    "wn2_workflow_kpi": {"p50_ms": "DOUBLE", "p90_ms": "DOUBLE"},
    "wn5_page_index": {"idx": "INTEGER"},
    "wn7_cumulative_precision": {"tp": "BIGINT"},
}
