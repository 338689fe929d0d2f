"""JSONL transcripts, and tables of conversation turns, as typed events (SRC1-SRC8, PAR3-PAR9, FLT1-FLT3).

Whether a line is valid JSON, and which of a block's fields count, can't be said with Spark's JSON
functions (they accept trailing text and drop repeated keys); so lines go to Python in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import clean_text, clean_user_text, decode_project, trim_ws
from threadloom.schemas import EVENTS

# Event types that are no turn, and the lengths of summaries.
SKIPPED = frozenset(("progress", "system", "permission-mode", "last-prompt"))
COMMAND_CHARS, VALUE_CHARS, RESULT_CHARS, PAIRS = 160, 80, 120, 3
UNTOLD_KEYS = frozenset(("content", "old_string", "new_string"))
CWD_LINES = 20

_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS, _BLANKS = re.compile(f"[{_SPACES}]+"), re.compile("[ \t]+")


def _plain(value: Any) -> str | None:
    """Scalars as JSON writes them; null, lists and objects have no plain text."""
    if isinstance(value, str):
        return value
    return json.dumps(value) if isinstance(value, (bool, int, float)) else None


def _compact(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _short(text: str, limit: int) -> str:
    flat = _RUNS.sub(" ", text).strip(" ")
    return flat if len(flat) <= limit else flat[: limit - 1].rstrip(_SPACES) + "..."


def _named(name: str, detail: str | None) -> str:
    return name if detail is None else f"{name}: {detail}"


def _command(given: dict) -> str | None:
    return _short(_plain(given.get("command")) or "", COMMAND_CHARS) or None


def _file(given: dict) -> str | None:
    return _plain(given["file_path"] if "file_path" in given else given.get("path"))


def _search(given: dict) -> str | None:
    return ", ".join(filter(None, (_plain(given.get(k)) for k in ("pattern", "path")))) or None


def _todos(given: dict) -> str | None:
    return f"{len(given['todos'])} todos" if isinstance(given.get("todos"), list) else None


def _pairs(given: dict) -> str | None:
    told = [k for k in sorted(given) if k not in UNTOLD_KEYS][:PAIRS]
    texts = ((k, _plain(given[k])) for k in told)
    return ", ".join(f"{k}={_short(_compact(given[k]) if v is None else v, VALUE_CHARS)}" for k, v in texts) or None


_DETAIL = {"Bash": _command, "TodoWrite": _todos} | dict.fromkeys(("Read", "Edit", "MultiEdit", "Write"), _file) | dict.fromkeys(("Grep", "Glob"), _search)


def tool_use(block: dict) -> str:
    """PAR5."""
    name = _plain(block.get("name"))
    name = "tool" if name is None else name
    given = block.get("input")
    return _named(name, _DETAIL.get(name, _pairs)(given)) if isinstance(given, dict) else name


def tool_result(block: dict) -> str:
    """PAR6."""
    content = block.get("content", "")
    if isinstance(content, list):
        text = " ".join(t for x in content if isinstance(x, dict) and (t := _plain(x.get("text"))) is not None)
    else:
        plain = _plain(content)
        text = _compact(content) if plain is None else plain
    cleaned = "\n".join(_BLANKS.sub(" ", x).rstrip(_SPACES) for x in text.replace("\r\n", "\n").split("\n")).strip(_SPACES)
    return _named("Tool result error" if block.get("is_error") is True else "Tool result", _short(cleaned.split("\n")[0], RESULT_CHARS) if cleaned else None)


def _blocks(content: Any) -> list[dict]:
    return [x for x in content if isinstance(x, dict)] if isinstance(content, list) else []


def _of_hook(event: dict, content: Any) -> bool:
    """FLT3. A null under the first key hides the second one."""
    if (event["hook_event_name"] if "hook_event_name" in event else event.get("hook")) is not None:
        return True
    kind = event.get("type")
    told = content.lower() if isinstance(content, str) and content.isascii() else "".join(c.lower() if c < "\x80" else c for c in content) if isinstance(content, str) else ""
    return (isinstance(kind, str) and kind.startswith("hook")) or "<hook" in told or "hook injection" in told


def event_of(line: str) -> tuple[bool, bool, str, str, list[str], str | None, str | None]:
    """(valid, skip, kind, raw text, tools, ts, cwd) of a line. Texts are cleaned later, as columns."""
    try:
        event = json.loads(line, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return False, True, "", "", [], None, None
    if not isinstance(event, dict):
        return True, True, "", "", [], None, None
    cwd = event["cwd"] if isinstance(event.get("cwd"), str) else None
    message = event.get("message") if isinstance(event.get("message"), dict) else {}
    content, kind, role = message.get("content"), event.get("type"), message.get("role")
    who = "user" if "user" in (kind, role) else "assistant" if "assistant" in (kind, role) else ""
    if (isinstance(kind, str) and kind in SKIPPED) or _of_hook(event, content) or not who:
        return True, True, "", "", [], None, cwd
    blocks = _blocks(content)
    summary, made = ("tool_result", tool_result) if who == "user" else ("tool_use", tool_use)
    texts = [content] if isinstance(content, str) else []
    for b in blocks:
        if b.get("type") == "text":
            texts.append(_plain(b.get("text")))
        elif who == "user" and b.get("type") != summary:
            texts.append(b.get("content") if isinstance(b.get("content"), str) else None)
    ts = _plain(event["timestamp"] if "timestamp" in event else event.get("created_at"))
    return True, False, who, "\n".join(t for t in texts if t is not None), [made(b) for b in blocks if b.get("type") == summary], ts, cwd


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed events from (session_id, line, text). Blank lines are left out but keep their numbers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = list(zip(*map(event_of, b.column(2).to_pylist()), strict=True)) or [[]] * 7
            types = (pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, t) for x, t in zip(found, types, strict=True))], ["session_id", "line", "valid", "skip", "kind", "raw", "tools", "ts", "cwd"])

    told = lines.where(trim_ws(F.col("text")) != "").select("session_id", F.col("line").cast("bigint"), "text")
    parsed = told.mapInArrow(run, "session_id string, line bigint, valid boolean, skip boolean, kind string, raw string, tools array<string>, ts string, cwd string")
    return cleaned(parsed)


def cleaned(events: DataFrame) -> DataFrame:
    user = F.when(F.col("kind") == "user", clean_user_text(F.col("raw"))).otherwise("")
    assistant = F.when(F.col("kind") == "assistant", clean_text(F.col("raw"))).otherwise("")
    return events.withColumns({"user_text": user, "assistant_text": assistant}).select(*[x.split(" ")[0] for x in EVENTS.split(", ")])


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Typed events of a conversations table: a conversation is a session, a turn is a line."""
    return cleaned(
        conversations.select(
            F.col("conv_id").cast("string").alias("session_id"),
            (F.col("turn") + 1).alias("line"),
            F.lit(True).alias("valid"),
            (~F.coalesce(F.col("role"), F.lit("")).isin("user", "assistant")).alias("skip"),
            F.coalesce("role", F.lit("")).alias("kind"),
            F.coalesce("text", F.lit("")).alias("raw"),
            F.array().cast("array<string>").alias("tools"),
            F.lit(None).cast("string").alias("ts"),
            F.lit(None).cast("string").alias("cwd"),
        )
    )


def scan(spark: SparkSession, root: str) -> DataFrame:
    """SRC1-SRC4, SRC8: (session_id, project_path, transcript_path, mtime, size, sha256, content) of every
    transcript below ``root``, of files with one name the oldest. A missing root has none."""
    shape = "session_id string, project_path string, transcript_path string, mtime string, size bigint, sha256 string, content binary"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], shape)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root)
    path = F.regexp_replace("path", r"\Afile:/+", "/")
    first = F.slice(F.split(F.expr("try_validate_utf8(cast(content as string))"), "\n"), 1, CWD_LINES)
    told = F.filter(F.transform(first, lambda x: F.get_json_object(x, "$.cwd")), lambda x: x.isNotNull())
    utc = F.to_utc_timestamp("modificationTime", F.current_timezone())
    found = files.select(
        F.regexp_extract(path, r"([^/]+)\.jsonl\z", 1).alias("session_id"),
        F.coalesce(F.get(told, 0), decode_project(F.regexp_extract(path, r"([^/]*)/[^/]+\z", 1))).alias("project_path"),
        path.alias("transcript_path"),
        F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00")).alias("mtime"),
        F.col("length").alias("size"),
        F.sha2("content", 256).alias("sha256"),
        "content",
    )
    oldest = found.withColumn("_nth", F.expr("row_number() over (partition by session_id order by mtime, transcript_path)"))
    return oldest.where("_nth = 1").drop("_nth")


def transcript_lines(files: DataFrame) -> DataFrame:
    """SRC6: numbered lines of transcripts; of files that aren't UTF-8 one line that is no JSON."""
    text = F.coalesce(F.expr("try_validate_utf8(cast(content as string))"), F.lit("\ufffd"))
    split = F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)
    return files.select("session_id", F.posexplode(split).alias("_pos", "text")).select("session_id", (F.col("_pos") + 1).alias("line"), F.regexp_replace("text", r"\r\z", "").alias("text"))


