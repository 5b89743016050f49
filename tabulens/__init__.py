"""Table profiling on Spark: types, statistics, charts, findings and derived columns."""

from tabulens.plans.features import add_features, feature_catalogue, suggest_features
from tabulens.plans.importance import score_columns
from tabulens.plans.insights import find_insights
from tabulens.plans.profile import column_metrics, profile, profile_frame, quality_summary
from tabulens.plans.report import Report, digest, full_report
from tabulens.plans.sketches import merge_sketches, sketch, sketched_profile
from tabulens.plans.types import detect_types
from tabulens.sources import clean_table, read_csv, read_json, read_table, write_report

__all__ = [
    "Report", "add_features", "clean_table", "column_metrics", "detect_types", "digest",
    "feature_catalogue", "find_insights", "full_report", "merge_sketches", "profile",
    "profile_frame", "quality_summary", "read_csv", "read_json", "read_table", "score_columns",
    "sketch", "sketched_profile", "suggest_features", "write_report",
]
