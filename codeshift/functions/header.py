"""Snippet header fields carried in the first lines of a code block.

Block layout (line 0 is the blank rest of the opening fence line)::

    <blank>
    // <path>
    // <start>/<end>
    // <repo url>
    // <language>
    <code ...>

Each header line loses its first three characters (the comment marker and a
space) and is stripped.  Missing lines give NULL fields instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, py_rstrip, py_strip

# Language -> build command.
RUN_COMMANDS = {"c#": "dotnet build", "c++": "make"}


def _after_marker(line: Column) -> Column:
    return F.substr(line, F.lit(4))


def header_parts(block) -> Column:
    """The five header lines and the rest of the block, from one split:
    ``split(block, '\\n', 6)`` leaves the code (everything after the fifth
    newline) whole in the sixth piece, so the code is never cut into lines."""
    return F.split(col_(block), "\n", 6)


def header_fields(block=None, parts: Column | None = None) -> dict[str, Column]:
    """D7-D10 fields.  Pass ``parts`` (a column holding ``header_parts``)
    to reuse one split for every field."""
    hp = parts if parts is not None else header_parts(block)
    path = _after_marker(F.get(hp, 1))
    span = F.split(_after_marker(F.get(hp, 2)), "/", -1)
    url = _after_marker(F.get(hp, 3))
    lang = _after_marker(F.get(hp, 4))
    code = F.coalesce(F.get(hp, 5), F.lit(""))
    language = py_strip(lang)
    return {
        "repo_url": F.concat(py_strip(url), F.lit(".git")),
        "repo_name": py_strip(F.element_at(F.split(url, "/", -1), -1)),
        "path_to_snippet": py_strip(path),
        "snippet_func_name": snippet_func_name(code),
        "snippet_line_start": py_strip(F.get(span, 0)).try_cast("int"),
        "snippet_line_end": py_strip(F.get(span, 1)).try_cast("int"),
        "language": language,
        "run_command": run_command(language),
        "original_code": py_rstrip(code),
    }


def parse_snippet_header(block) -> Column:
    """D7 as one struct column."""
    return F.struct(*[c.alias(n) for n, c in header_fields(block).items()])


def snippet_func_name(code) -> Column:
    """First line of the code, stripped."""
    return py_strip(F.substring_index(col_(code), "\n", 1))


def repo_identity(url) -> Column:
    """struct<repo_name, repo_url> from a raw header URL."""
    url = col_(url)
    return F.struct(py_strip(F.element_at(F.split(url, "/", -1), -1)).alias("repo_name"),
                    F.concat(py_strip(url), F.lit(".git")).alias("repo_url"))


def run_command(language) -> Column:
    """Build command for a language, '' when unknown."""
    lang = F.lower(col_(language))
    expr = F.when(F.lit(False), F.lit(""))
    for name, cmd in RUN_COMMANDS.items():
        expr = expr.when(lang == name, F.lit(cmd))
    return expr.otherwise(F.lit(""))
