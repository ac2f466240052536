"""Log triage on Spark: reduce large logs to the lines that explain an issue."""

from logtriage.config import AnalysisDefaults, KeywordFilterConfig, VectorFilterConfig

__all__ = ["AnalysisDefaults", "KeywordFilterConfig", "VectorFilterConfig"]
