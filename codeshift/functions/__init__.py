"""Column -> Column functions."""

from .complexity import complexity_profile, cyclomatic_complexity, decision_points, python_complexity
from .distance import (edit_distance, edit_similarity, ndiff_distance, run_distance,
                       syntactic_similarity)
from .header import (header_fields, parse_snippet_header, repo_identity, run_command,
                     snippet_func_name)
from .lines import comment_ratio, line_profile, python_raw_profile, token_count
from .text import (escape_whitespace, fenced_blocks, fold_non_ascii, has_fence, lines_of,
                   py_lstrip, py_rstrip, py_strip, unescape_whitespace)

__all__ = [
    "comment_ratio", "complexity_profile", "cyclomatic_complexity", "decision_points", "edit_distance",
    "edit_similarity", "escape_whitespace", "fenced_blocks", "fold_non_ascii", "has_fence",
    "header_fields", "line_profile", "lines_of", "ndiff_distance", "parse_snippet_header",
    "py_lstrip", "py_rstrip", "py_strip", "python_complexity", "python_raw_profile",
    "repo_identity", "run_command", "run_distance", "snippet_func_name",
    "syntactic_similarity", "token_count", "unescape_whitespace",
]
