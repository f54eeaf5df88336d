"""Compositions of operators: profile, statistics, quality report, feature engineering, guided run."""

from .changes import cell_changes
from .dataset import Dataset
from .statistics import (column_overview, dataset_metrics, dataset_summary, describe, detect_changes, dominant_type,
                       merge_descriptions, profile_table, suggest, summary_lines, type_distribution)
from .features import engineer
from .guided import GuidedResult, clean_table, dashboard_tables, guided_run
from .incremental import ProfileState, profile_state
from .missing import missing_patterns, missing_together
from .profiling import categorical_threshold, profile, profile_values
from .quality import quality_report

__all__ = [
    "ProfileState", "profile_state", "cell_changes", "missing_patterns", "missing_together", "Dataset", "GuidedResult", "categorical_threshold", "clean_table", "column_overview", "dashboard_tables",
    "dataset_metrics", "dataset_summary", "describe", "detect_changes", "dominant_type", "engineer", "guided_run",
    "merge_descriptions", "profile", "profile_table", "profile_values", "quality_report", "suggest",
    "summary_lines", "type_distribution",
]
