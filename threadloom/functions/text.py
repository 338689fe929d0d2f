"""Text functions as Column expressions (TXT1-TXT19); all run inside the JVM.

White space means the Unicode property, as the semantics to be met define it; characters are code points.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\p{IsWhite_Space}"
# Limits and texts that results must have.
OMITTED, TRUNCATED, ELLIPSIS, UNTITLED = "[long output omitted]", " [truncated]", "...", "Conversation"
FENCE_CHARS, FENCE_LINES, LOG_LINES, LOG_HEAD, LOG_TAIL, LINE_CHARS, TITLE_CHARS = 1200, 40, 120, 80, 20, 500, 80


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def rtrim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"{WS}+\z", "")


def lines(c: Column) -> Column:
    """Lines without their ends; an end at the end opens no further line, and no text has no line."""
    body = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), r"\n\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def collapse_spaces(c: Column) -> Column:
    """TXT3 for every line of a text: runs of blanks and tabs become one blank, line ends are trimmed."""
    return F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), rf"[{WS}&&[^\n]]+(?=\n|\z)", "")


def clean_text(c: Column) -> Column:
    """TXT1."""
    return trim_ws(collapse_spaces(F.regexp_replace(c, "\r\n", "\n")))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; characters keep their places."""
    return F.translate(c, _UPPER, _LOWER)


def strip_tag(c: Column, start: str, end: str) -> Column:
    """TXT5: takes out the first opening mark with all up to the next closing one, until no such pair is left;
    marks that a removal forms count. Each step uses up a closing mark, whose number bounds the steps."""
    start, end = start.lower(), end.lower()

    def step(x: Column, _: Column) -> Column:
        low = ascii_lower(x)
        at = F.instr(low, start)
        upto = F.call_function("locate", F.lit(end), low, at + len(start))
        return F.when((at > 0) & (upto > 0), F.concat(F.left(x, at - 1), F.substr(x, upto + len(end)))).otherwise(x)

    low = ascii_lower(c)
    marks = F.size(F.split(low, rf"\Q{end}\E", -1)) - 1
    return F.when(F.contains(low, F.lit(start)) & (marks > 0), F.aggregate(F.sequence(F.lit(1), marks), c, step)).otherwise(c)


def clean_user_text(c: Column) -> Column:
    """TXT2."""
    return clean_text(strip_tag(c, "<system-reminder>", "</system-reminder>"))


def contains_ci(c: Column, needle: str) -> Column:
    """TXT6 for an ASCII needle."""
    return F.contains(ascii_lower(c), F.lit(needle.lower()))


def truncate(c: Column, limit: int) -> Column:
    """TXT4."""
    flat = F.regexp_replace(trim_ws(c), f"{WS}+", " ")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(rtrim_ws(F.left(flat, F.lit(limit - 1))), F.lit(ELLIPSIS)))


def clean_fences(c: Column) -> Column:
    """TXT9: what stands between two fences is every second part; the last part is never closed."""
    parts = F.split(c, "```", -1)
    long = lambda p: (F.length(p) > FENCE_CHARS) | (F.size(lines(p)) > FENCE_LINES)
    return F.array_join(F.transform(parts, lambda p, i: F.when((i % 2 == 1) & (i < F.size(parts) - 1) & long(p), F.lit(OMITTED)).otherwise(p)), "```")


def drop_long_logs(c: Column) -> Column:
    """TXT10."""
    own = lines(c)
    short = F.concat(F.slice(own, 1, LOG_HEAD), F.array(F.lit(OMITTED)), F.slice(own, -LOG_TAIL, LOG_TAIL))
    return F.when(F.size(own) <= LOG_LINES, c).otherwise(F.array_join(short, "\n"))


def truncate_lines(c: Column) -> Column:
    """TXT11 for every line."""
    return F.array_join(F.transform(lines(c), lambda x: F.when(F.length(x) <= LINE_CHARS, rtrim_ws(x)).otherwise(F.concat(rtrim_ws(F.left(x, F.lit(LINE_CHARS))), F.lit(TRUNCATED)))), "\n")


def collapse_blank_lines(c: Column) -> Column:
    """TXT12 with the trim that always follows it: two blank lines in a row at most."""
    return trim_ws(F.regexp_replace(F.regexp_replace(c, rf"(?m)^[{WS}&&[^\n]]+$", ""), "\n{4,}", "\n\n\n"))


def clean_for_embedding(c: Column) -> Column:
    """TXT8."""
    bare = strip_tag(strip_tag(c, "<!--", "-->"), "<system-reminder>", "</system-reminder>")
    return collapse_blank_lines(truncate_lines(drop_long_logs(clean_fences(bare))))


def render_turn(user: Column, assistant: Column, tools: Column) -> Column:
    """TXT13."""
    said = F.when(assistant != "", F.concat(F.lit("Assistant: "), assistant))
    used = F.when(F.size(tools) > 0, F.concat(F.lit("Tools:\n- "), F.array_join(tools, "\n- ")))
    return trim_ws(F.concat_ws("\n\n", F.concat(F.lit("User: "), user), said, used))


def title(user: Column) -> Column:
    """TXT14."""
    first = F.coalesce(F.get(lines(user), 0), F.lit(""))
    return F.when(first == "", F.lit(UNTITLED)).when(F.length(first) <= TITLE_CHARS, first).otherwise(F.concat(rtrim_ws(F.left(first, F.lit(TITLE_CHARS - 1))), F.lit(ELLIPSIS)))


def token_count(c: Column) -> Column:
    """TXT15."""
    return F.when(c == "", 0).otherwise(F.greatest(F.lit(1), F.regexp_count(c, F.lit(rf"[^{WS}]+")))).cast("bigint")


def content_hash(c: Column) -> Column:
    """TXT16."""
    return F.left(F.sha2(c, 256), F.lit(16))


def normalize_timestamp(c: Column) -> Column:
    """TXT17: a time with an offset, in UTC; anything else as it is. Fractions keep 9 digits, shown by threes."""
    shape = r"\A(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(?:\.(\d+))?([Zz]|[+-]\d\d:\d\d)\z"
    at = F.when(c.rlike(shape), F.try_to_timestamp(F.upper(F.regexp_replace(c, shape, "$1T$2$4"))))
    utc = F.to_utc_timestamp(at, F.current_timezone())
    digits = F.rpad(F.left(F.regexp_extract(c, shape, 3), F.lit(9)), 9, "0")
    fraction = F.regexp_replace(digits, r"(?:000)+\z", "")
    return F.coalesce(F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("+00:00")), c)


def expand_path(path: str) -> str:
    """TXT18, on the driver."""
    return str(Path(path).expanduser()) if path == "~" or path.startswith("~/") else path


def decode_project(name: Column) -> Column:
    """SRC5: the project path that a folder's name stands for."""
    return F.when(name.startswith("-"), F.replace(name, F.lit("-"), F.lit("/"))).otherwise(name)
