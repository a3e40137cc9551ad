"""DuckDB SQL building blocks for the cross-engine check.

Each registered query has an independent SQL statement over the driver's
parquet views.  These helpers generate the recurring CTEs (transcript view,
pairs, header fields, window-form line profile, records) so the statements
stay readable.  The line profile here is the *window* form (unnest +
``last_value ... IGNORE NULLS``), deliberately different from the Spark
side's in-row ``aggregate``.
"""

from __future__ import annotations

from ..functions.distance import LETTERS, STAND_INS
from ..operators.codemetrics import PAIR_METRICS
from ..sources.tables import CODE_REWRITES, FUNCTION_HEAD, LEAD_LINES, NEXT_FUNCTION, PYTHON_HEAD, SECOND_BLOCK

# Python's whitespace set in RE2 syntax (same characters as text.PY_WHITESPACE).
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NL = "chr(10)"
METRICS = list(PAIR_METRICS)
TURN_TYPE = "BIGINT"
PROFILE = ["LOC", "comment", "blank", "chars", "tokens"]


def lit(s: str) -> str:
    """A SQL string literal; newlines become chr(10) concatenations."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return f" || {NL} || ".join(quoted) if len(parts) > 1 else quoted[0]


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+$', '', 'g')"


def fold(x: str, repl: str = "?") -> str:
    return f"regexp_replace({x}, '[^\\x00-\\x7F]', '{repl}', 'g')"


def one_byte(x: str) -> str:
    """Accented letters as control characters: DuckDB's distance counts bytes."""
    stand_ins = " || ".join(f"chr({ord(c)})" for c in STAND_INS)
    return fold(f"translate({x}, '{LETTERS}', {stand_ins})")


def as_code(x: str) -> str:
    out = x
    for a, b in [*CODE_REWRITES, NEXT_FUNCTION]:
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    return f"CASE WHEN length({x}) % 5 = 0 THEN {out} ELSE {lit(FUNCTION_HEAD)} || {out} END"


def as_python(x: str) -> str:
    return f"CASE WHEN length({x}) % 5 = 0 THEN {x} ELSE {lit(PYTHON_HEAD)} || {x} END"


# The complexity rules again, in the plain form that RE2 knows (no possessive
# runs, no lookahead).
SQL_NOISE = {"c": r"""(?s)/\*.*?(?:\*/|\z)|//[^\n]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)'""",
             "python": r"""#[^\n]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""}
SQL_DECISIONS = {"c": r"\b(?:if|for|foreach|while|case|catch)\b|&&|\|\||\?",
                 "python": r"\b(?:if|elif|for|while|except|and|or|assert)\b"}
SQL_FUNCTION = {"c": r"\b[A-Za-z_][A-Za-z0-9_]*\s*\([^()]*\)\s*(?:\{|=>)", "python": r"\bdef\s+[A-Za-z_][A-Za-z0-9_]*\s*\("}
SQL_STRINGS = r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'"""
SQL_HEADS = r"\b(if|for|foreach|while|switch|catch|using|lock|fixed)\s*\("


def cleaned(x: str, style: str) -> str:
    return f"regexp_replace({fold(x, '#')}, {lit(SQL_NOISE[style])}, ' ', 'g')"


def decisions(x: str, style: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {lit(SQL_DECISIONS[style])})) AS INTEGER)"


def decision_points(x: str, style: str = "c") -> str:
    return decisions(cleaned(x, style), style)


def complexity(x: str, style: str = "c") -> str:
    """1 + decision points between the first function and the next; NULL without one."""
    c = cleaned(x, style)
    if style == "c":
        c = f"regexp_replace({c}, {lit(SQL_HEADS)}, '\\1 [', 'g')"
    body = f"regexp_split_to_array({c}, {lit(SQL_FUNCTION[style])})[2]"
    return f"1 + {decisions(body, style)}"


def fenced(x: str) -> str:
    return f"regexp_extract_all({x}, '(?s)```(.*?)```', 1)"


def unescape(x: str) -> str:
    return f"replace(replace({x}, '\\n', {NL}), '\\t', chr(9))"


def escape(x: str) -> str:
    return f"replace(replace({x}, {NL}, '\\n'), chr(9), '\\t')"


# Fixed values, written out again so that an error on the Spark side would show.
SQL_LABELS = ["Bugs, Fix", "Rewrite, Efficiency", "Refactor, Readability", "Refactor, CodeBlock", "Improve, SufficientQuality",
              "Bugs, CodeBlock", "Rewrite, CodeBlock", "Improve, BackwardCompatible"]
SQL_BUG_FIX = "Given the above C# code your task is to find and fix bugs in it."


def label_case(x: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in enumerate(SQL_LABELS))
    return f"CASE {x} {whens} END"


def clean_prompt(x: str) -> str:
    return f"replace(replace({x}, {NL}, ''), '```', {lit(SQL_BUG_FIX)})"


# ------------------------------------------------------------------ CTEs

def messages_ctes() -> list[str]:
    lead = " || ".join(f"repeat({lit(x)}, CAST(conv_id % 6 AS INTEGER))" for x in LEAD_LINES)
    lead += f" || CASE WHEN conv_id % 6 >= 2 THEN {lit(FUNCTION_HEAD)} ELSE '' END"
    user = (f"'```' || {NL} || ' // src/file' || CAST(conv_id AS VARCHAR) || '.cs' || {NL} || ' // ' "
            f"|| CAST(turn*10 AS VARCHAR) || '/' || CAST(turn*10+5 AS VARCHAR) || {NL} "
            f"|| ' // https://example.com/org/repo' || CAST(conv_id % 6 AS VARCHAR) || {NL} || ' // ' "
            f"|| CASE conv_id % 3 WHEN 0 THEN 'c#' WHEN 1 THEN 'c++' ELSE 'python' END || {NL} "
            f"|| code || {NL} || ' ```' || {NL} || 'prompt ' || CAST((conv_id + turn) % 8 AS VARCHAR) "
            f"|| CASE WHEN (conv_id + turn) % 11 = 3 THEN {lit(SECOND_BLOCK)} ELSE '' END")
    assistant = (f"CASE WHEN (conv_id + turn) % 7 = 0 THEN code WHEN (conv_id + turn) % 7 = 1 AND conv_id % 6 < 3 THEN '```' || code "
                 f"WHEN (conv_id + turn) % 7 = 2 THEN '```csharp' || {NL} || code || {NL} || '```' || {NL} || 'and' || {NL} || '```' || code || '```' "
                 f"ELSE 'Here:' || {NL} || '```csharp' || {NL} || code || {NL} || '```' END")
    return [
        f"sm_c AS (SELECT conv_id, turn, role, text, {lead} || ({as_code('text')}) AS code FROM conversations)",
        ("session_messages AS (SELECT CASE WHEN conv_id % 20 >= 15 THEN conv_id - (conv_id % 20 - 15) ELSE conv_id END AS session_id, "
         f"CAST(CASE WHEN conv_id % 20 >= 15 THEN (conv_id % 20 - 15) * 100 + turn ELSE turn END AS {TURN_TYPE}) AS idx, role, "
         f"CASE WHEN role = 'user' THEN {user} WHEN role = 'assistant' THEN {assistant} ELSE text END AS content, "
         f"CASE WHEN role = 'user' THEN 'prompt ' || CAST((conv_id + turn) % 8 AS VARCHAR) ELSE '' END AS prompt "
         "FROM sm_c)"),
    ]


def numbered(ctes: list[str]) -> list[str]:
    """``ctes`` over messages numbered by their place: a written transcript is
    an array, which has no gaps."""
    out = []
    for c in ctes:
        if c.startswith("session_messages AS ("):
            out += ["session_raw AS (" + c.removeprefix("session_messages AS ("),
                    f"session_messages AS (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS {TURN_TYPE}) "
                    "AS idx) FROM session_raw)"]
        else:
            out.append(c)
    return out


def turns_cte() -> str:
    return ("turns AS (SELECT u.session_id, u.idx, u.prompt, u.content AS user_content, a.content AS answer_content "
            "FROM session_messages u JOIN session_messages a ON a.session_id = u.session_id AND a.idx = u.idx + 1 "
            "WHERE u.role = 'user' AND a.role = 'assistant')")


def merged_answer(x: str) -> str:
    return f"array_to_string(list_transform({fenced(x)}, lambda b: replace(b, 'csharp', '')), {NL})"


def pairs_ctes() -> list[str]:
    return messages_ctes() + [
        turns_cte(),
        ("pairs_b AS (SELECT session_id, idx, prompt, "
         f"{fenced(unescape('user_content'))} AS ub, {merged_answer('answer_content')} AS updated_code "
         "FROM turns WHERE instr(answer_content, '```') > 0)"),
        ("pairs AS (SELECT session_id, idx, prompt, ub[1] AS original_block, updated_code, "
         "CAST(len(ub) AS INTEGER) AS n_user_blocks FROM pairs_b WHERE ub[1] IS NOT NULL)"),
    ]


def header_ctes(src: str = "pairs") -> list[str]:
    L = "L"
    code = f"array_to_string({L}[6:], {NL})"
    url = f"substr({L}[4], 4)"
    lang = strip(f"substr({L}[5], 4)")
    span = f"string_split(substr({L}[3], 4), '/')"
    return [
        f"hdr_l AS (SELECT *, string_split(original_block, {NL}) AS {L} FROM {src})",
        ("hdr AS (SELECT session_id, idx, prompt, original_block, updated_code, "
         f"{strip(url)} || '.git' AS repo_url, "
         f"{strip(f'string_split({url}, {chr(39)}/{chr(39)})[-1]')} AS repo_name, "
         f"{strip(f'substr({L}[2], 4)')} AS path_to_snippet, "
         f"{strip(f'string_split({code}, {NL})[1]')} AS snippet_func_name, "
         f"TRY_CAST({strip(f'{span}[1]')} AS INTEGER) AS snippet_line_start, "
         f"TRY_CAST({strip(f'{span}[2]')} AS INTEGER) AS snippet_line_end, "
         f"{lang} AS language, "
         f"CASE lower({lang}) WHEN 'c#' THEN 'dotnet build' WHEN 'c++' THEN 'make' ELSE '' END AS run_command, "
         f"{rstrip(code)} AS original_code FROM hdr_l)"),
    ]


def profile_ctes(name: str, src: str, ids: list[str], text: str) -> list[str]:
    """Window-form line profile of ``text`` per ``ids`` -> CTE ``name``."""
    idl = ", ".join(ids)
    idq = ", ".join(f"t.{i}" for i in ids)
    return [
        (f"{name}_l AS (SELECT {idq}, u.pos, {strip('u.line')} AS s "
         f"FROM {src} t, unnest(string_split({text}, {NL})) WITH ORDINALITY AS u(line, pos))"),
        (f"{name}_e AS (SELECT *, CASE WHEN starts_with(s, '/*') AND NOT ends_with(s, '*/') THEN 1 "
         f"WHEN NOT starts_with(s, '//') AND NOT starts_with(s, '/*') AND ends_with(s, '*/') THEN 0 END AS ev "
         f"FROM {name}_l)"),
        (f"{name}_c AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY {idl} ORDER BY pos "
         f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inc FROM {name}_e)"),
        (f"{name}_k AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN starts_with(s, '//') OR starts_with(s, '/*') "
         f"OR ends_with(s, '*/') OR inc = 1 THEN 'comment' ELSE 'loc' END AS cls FROM {name}_c)"),
        (f"{name} AS (SELECT {idl}, CAST(count_if(cls = 'loc') AS INTEGER) AS LOC, "
         f"CAST(count_if(cls = 'comment') AS INTEGER) AS comment, CAST(count_if(cls = 'blank') AS INTEGER) AS blank, "
         f"CAST(coalesce(sum(CASE WHEN cls = 'loc' THEN length(s) END), 0) AS INTEGER) AS chars, "
         f"CAST(coalesce(sum(CASE WHEN cls = 'loc' THEN len(string_split_regex(s, '{WS}+')) END), 0) AS INTEGER) AS tokens "
         f"FROM {name}_k GROUP BY {idl})"),
    ]


def ratio(alias: str) -> str:
    return f"CASE WHEN {alias}.LOC = 0 THEN -1.0 ELSE {alias}.comment / {alias}.LOC END"


def records_ctes(measure_block: bool = True) -> list[str]:
    measured = "original_block" if measure_block else "original_code"
    ctes = pairs_ctes() + header_ctes()
    ctes += profile_ctes("prof_o", "hdr", ["session_id", "idx"], measured)
    ctes += profile_ctes("prof_u", "hdr", ["session_id", "idx"], "updated_code")
    ctes.append(
        "hdr_d AS (SELECT *, CAST(levenshtein(" + one_byte(measured) + ", " + one_byte("updated_code") + ") AS BIGINT) AS dist, "
        + complexity(measured) + " AS cco, " + complexity("updated_code") + " AS ccu FROM hdr)")
    cols = ["h.repo_url", "h.repo_name", "h.path_to_snippet", "h.snippet_func_name", "h.snippet_line_start",
            "h.snippet_line_end", "h.language", "h.run_command"]
    sim = f"1.0 - CAST(h.dist AS DOUBLE) / nullif(greatest(length(h.{measured}), length(h.updated_code)), 0)"
    for side, a in (("original", "o"), ("updated", "u")):
        cols += [f"{a}.{m} AS {side}_{m}" for m in PROFILE]
        cols += [f"{ratio(a)} AS {side}_comment_per_LOC", f"h.dist AS {side}_levenshtein_distance",
                 f"{sim} AS {side}_syntactic_similarity",
                 f"CAST(CASE WHEN h.cco IS NULL OR h.ccu IS NULL THEN -1 ELSE h.cc{a} END AS INTEGER) "
                 f"AS {side}_cyclomatic_complexity"]
    cols += ["h.original_code", "h.updated_code", "h.prompt", "h.session_id", "h.idx"]
    ctes.append("records AS (SELECT " + ", ".join(cols) + " FROM hdr_d h JOIN prof_o o USING (session_id, idx) "
                "JOIN prof_u u USING (session_id, idx))")
    return ctes


def scored_ctes(stats_digits: int = 6) -> list[str]:
    """D12 -> G1 -> G2 -> I2 -> I1 over ``records``."""
    ctes = records_ctes()
    ctes += [
        f"cl AS (SELECT * REPLACE ({clean_prompt('prompt')} AS prompt) FROM records)",
        ("dict AS (SELECT prompt, CAST(row_number() OVER (ORDER BY f, prompt) - 1 AS INTEGER) AS prompt_ord "
         "FROM (SELECT prompt, min(struct_pack(s := session_id, i := idx)) AS f FROM cl GROUP BY prompt))"),
        f"lab AS (SELECT cl.*, d.prompt_ord, {label_case('d.prompt_ord')} AS prompt_id FROM cl LEFT JOIN dict d USING (prompt))",
        "grp AS (SELECT repo_name, prompt_id, count(*) AS n FROM lab GROUP BY repo_name, prompt_id)",
        "snip AS (SELECT max(n) AS snippet_count FROM grp)",
        ("pr AS (SELECT l.*, round_even((g.n / s.snippet_count) * 100, 1) AS pass_rate FROM lab l "
         "LEFT JOIN grp g ON g.repo_name = l.repo_name AND g.prompt_id = l.prompt_id CROSS JOIN snip s)"),
    ]
    stat_cols = []
    for side in ("original", "updated"):
        for m in METRICS:
            c = f"{side}_{m}"
            stat_cols += [f"min({c}) AS {c}_min", f"max({c}) AS {c}_max",
                          f"round_even(avg({c}), {stats_digits}) AS {c}_mean"]
    ctes.append("gs AS (SELECT repo_name, " + ", ".join(stat_cols) + " FROM pr GROUP BY repo_name)")
    ctes.append("scored AS (SELECT pr.*, gs.* EXCLUDE (repo_name) FROM pr LEFT JOIN gs USING (repo_name))")
    return ctes


def design_cte() -> str:
    return "design AS (SELECT count(*) AS design_size FROM session_messages WHERE role = 'user')"


def minmax_ctes(src: str, out: str, cols: list[str], key: str | None = None) -> list[str]:
    """H2 with its row guard: a row where any column is undefined (null, or
    constant in the table or group) keeps all raw values; else one decimal
    half-even, then the integer part."""
    over = f"OVER (PARTITION BY {key})" if key else "OVER ()"
    low = ", ".join(f"CAST(min({c}) {over} AS DOUBLE) AS {out}_lo_{i}, CAST(max({c}) {over} AS DOUBLE) AS {out}_hi_{i}" for i, c in enumerate(cols))
    n = [f"(CAST({c} AS DOUBLE) - {out}_lo_{i}) / nullif({out}_hi_{i} - {out}_lo_{i}, 0)" for i, c in enumerate(cols)]
    ok = " AND ".join(f"({x}) IS NOT NULL" for x in n)
    put = ", ".join(f"CASE WHEN {out}_ok THEN trunc(round_even({x}, 1)) ELSE CAST({c} AS DOUBLE) END AS {c}" for c, x in zip(cols, n))
    return [f"{out}_a AS (SELECT *, {low} FROM {src})", f"{out}_b AS (SELECT *, {ok} AS {out}_ok FROM {out}_a)",
            f"{out} AS (SELECT * REPLACE ({put}) FROM {out}_b)"]


def mean(x: str) -> str:
    """Mean that returns the common value exactly when a group is constant."""
    return f"CASE WHEN min({x}) = max({x}) THEN CAST(min({x}) AS DOUBLE) ELSE avg({x}) END"


def with_(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
