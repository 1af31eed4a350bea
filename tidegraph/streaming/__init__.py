"""Change logs, live results and their differences."""

from tidegraph.streaming.changelog import CHANGES, current_elements, element_tables, element_versions
from tidegraph.streaming.continuous import ContinuousQuery
from tidegraph.streaming.diff import diff_results

__all__ = ["CHANGES", "ContinuousQuery", "current_elements", "diff_results", "element_tables", "element_versions"]
