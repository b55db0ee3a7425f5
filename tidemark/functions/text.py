"""Text expressions: row text, traces, process samples, DDL, mapping expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tidemark.functions.scalars import Columnish, col, strict_long

# The text of a null column and the column separator of a row text.
NULL_TEXT = "~null~"
SEPARATOR = "|"

# Fixed value: a column mapping expression, one source column in ${...}.
MAPPING_PATTERN = r"^\$\{([A-Za-z][A-Za-z0-9_#$]*)\}$"

# Statements that need no decision on the target side.
IGNORED_PHRASE = "SUPPLEMENTAL LOG"
IGNORED_FIRST_WORDS = ("GRANT", "REVOKE", "AUDIT", "NOAUDIT", "ANALYZE", "LOCK", "COMMENT")


def row_text(columns: Sequence[Columnish]) -> Column:
    """All columns as text, nulls spelled out, joined by a bar."""
    parts = [F.coalesce(col(c).cast("string"), F.lit(NULL_TEXT)) for c in columns]
    return F.concat_ws(SEPARATOR, *parts)


# --- mapping expressions -----------------------------------------------------


def source_column(expr: Columnish) -> Column:
    """Upper-case source column of a mapping expression, null when it does not parse."""
    name = F.regexp_extract(F.trim(col(expr)), MAPPING_PATTERN, 1)
    return F.when(name != "", F.upper(name))


def is_identity(target: Columnish, expr: Columnish) -> Column:
    return F.coalesce(F.upper(col(target)) == source_column(expr), F.lit(False))


# --- schema changes ----------------------------------------------------------


def is_blank(text: Columnish) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(_strip(col(text)) == "", F.lit(True))


def is_ignorable(ddl: Columnish) -> Column:
    text = F.upper(_strip(col(ddl)))
    first_word = F.split(text, r"\s+", 2)[0]
    return text.contains(IGNORED_PHRASE) | first_word.isin(*IGNORED_FIRST_WORDS)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def first_line(text: Columnish, width: int = 120) -> Column:
    """First line of several; a single line is cut to ``width`` with an ellipsis."""
    stripped = _strip(col(text))
    cut = F.when(F.length(stripped) > width, F.concat(F.left(stripped, F.lit(width)), F.lit("…")))
    return F.when(F.instr(stripped, "\n") > 1, F.substring_index(stripped, "\n", 1)).otherwise(
        F.coalesce(cut, stripped)
    )


def _quoted(c: Column) -> Column:
    """Literal text inside a Java pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _replacement(c: Column) -> Column:
    """Literal text as a Java replacement: backslash and dollar lose their meaning."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def retarget_ddl(
    ddl: Columnish,
    schema: Columnish,
    table: Columnish,
    target_schema: Columnish,
    target_table: Columnish,
) -> Column:
    """Point a statement at the target table: qualified references, then bare ones.

    Both patterns stop at word borders, so ``S.T1`` never matches inside ``S.T10``.
    A statement is left alone when source and target names are the same.
    """
    text, s, t = col(ddl), col(schema), col(table)
    ts, tt = col(target_schema), col(target_table)
    target = _replacement(F.concat(F.lit('"'), ts, F.lit('"."'), tt, F.lit('"')))
    qualified = F.concat(
        F.lit(r'(?i)(?<![\w"])"?'), _quoted(s), F.lit(r'"?\."?'), _quoted(t), F.lit(r'"?(?!\w)')
    )
    # Fixed value: how a bare table name is told from part of another name.
    bare = F.concat(F.lit(r'(?i)(?<![\w."])"?'), _quoted(t), F.lit(r'"?(?![\w"])'))
    rewritten = F.regexp_replace(F.regexp_replace(text, qualified, target), bare, target)
    same = F.upper(F.concat_ws(".", s, t)) == F.upper(F.concat_ws(".", ts, tt))
    return F.when(same, text).otherwise(rewritten)


# --- connector traces --------------------------------------------------------


def cause_line(trace: Columnish) -> Column:
    """Text after the last ``Caused by: `` line, else the first line."""
    lines = F.split(col(trace), "\n")
    causes = F.filter(lines, lambda line: line.startswith("Caused by: "))
    last = F.substr(F.try_element_at(causes, F.lit(-1)), F.lit(len("Caused by: ") + 1))
    return F.when(F.length(col(trace)) > 0, F.trim(F.coalesce(last, lines[0])))


def effective_state(status: str = "status") -> Column:
    """FAILED when any task failed, else the connector's own state, else UNKNOWN."""
    failed = F.exists(f"{status}.tasks", lambda task: task["state"] == "FAILED")
    state = F.coalesce(F.col(f"{status}.connector.state"), F.lit("UNKNOWN"))
    return F.when(F.coalesce(failed, F.lit(False)), "FAILED").otherwise(state)


def status_trace(status: str = "status") -> Column:
    """Trace of the first task that has one, else of the connector."""
    traced = F.filter(f"{status}.tasks", lambda task: task["trace"].isNotNull())
    first = F.try_element_at(traced, F.lit(1))["trace"]
    return F.coalesce(first, F.col(f"{status}.connector.trace"))


def is_broken(state: Column) -> Column:
    return state.isin("FAILED", "UNKNOWN")


# --- process samples ---------------------------------------------------------


def rss_kb(status_text: Columnish) -> Column:
    """Resident set size from a process status text, -1 when absent or malformed."""
    word = F.regexp_extract(col(status_text), r"(?m)^VmRSS:\s*(\S+)", 1)
    return F.coalesce(strict_long(word), F.lit(-1).cast("bigint"))


def cpu_ticks(stat_text: Columnish) -> Column:
    """User plus system ticks from a process stat text, -1 when malformed.

    The process name may itself hold blanks and brackets, so fields count from
    the last closing bracket.
    """
    text = col(stat_text)
    fields = F.split(F.trim(F.substring_index(text, ")", -1)), r"\s+")
    user = strict_long(F.get(fields, 11))
    system = strict_long(F.get(fields, 12))
    ticks = F.when(text.contains(")"), user + system)
    return F.coalesce(ticks, F.lit(-1).cast("bigint"))


# --- display states ----------------------------------------------------------


def table_badge(state: Columnish, lag: Columnish, warn_above: int = 100) -> Column:
    s = col(state)
    return (
        F.when((s == "RUNNING") & (col(lag) > warn_above), "warn")
        .when(s == "RUNNING", "ok")
        .when(s.isin("PAUSED", "N/A"), "dim")
        .otherwise("crit")
    )
