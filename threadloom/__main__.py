"""Command line of the engine (API8-API16): python -m threadloom COMMAND."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from collections.abc import Sequence
from typing import TextIO

from pyspark.sql import SparkSession

from threadloom.config import Config, config_of
from threadloom.plans.engine import LIST, SEARCH, ArgumentError, Engine, NotFoundError


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="threadloom")
    out.add_argument("--project-dir", help="folder whose settings file overlays the user's")
    add = out.add_subparsers(dest="command").add_parser
    add("index").add_argument("--force", action="store_true")
    search = add("search")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=SEARCH[0])
    search.add_argument("--project")
    sessions = add("sessions")
    sessions.add_argument("--project")
    sessions.add_argument("--limit", type=int, default=LIST[0])
    add("scan").add_argument("--root")
    add("parse").add_argument("path")
    add("read").add_argument("session_id")
    migrate = add("migrate")
    migrate.add_argument("--from", dest="old", required=True)
    migrate.add_argument("--to", dest="new", required=True)
    for name in ("status", "config", "redact-db", "hook-stop", "hook-session-end"):
        add(name)
    return out


def hook_path(stdin: TextIO) -> str | None:
    """SRC9: the transcript that a hook's payload names; what isn't such a payload names none."""
    try:
        payload = json.load(stdin)
    except ValueError:
        return None
    path = payload.get("transcript_path") if isinstance(payload, dict) else None
    return path if isinstance(path, str) and path else None


def run(argv: Sequence[str] | None = None, spark: SparkSession | None = None, stdin: TextIO = sys.stdin, stdout: TextIO = sys.stdout, config: Config | None = None) -> int:
    """Runs one command; without any, the settings are shown. Gives the exit status."""
    args = parser().parse_args(argv)
    config = config or config_of(args.project_dir)
    say = lambda x: print(x if isinstance(x, str) else json.dumps(x, indent=2, ensure_ascii=False), file=stdout)
    if args.command in (None, "config"):
        say(dataclasses.asdict(config))
        return 0
    engine = Engine(spark or SparkSession.builder.appName("threadloom").getOrCreate(), config)
    try:
        if args.command == "index":
            say(engine.index(args.force)._asdict())
        elif args.command in ("hook-stop", "hook-session-end"):
            path = hook_path(stdin)
            if path:
                say(engine.index(paths=[path])._asdict())
        elif args.command == "status":
            say(engine.stats())
        elif args.command == "migrate":
            say(engine.migrate_project(args.old, args.new))
        elif args.command == "redact-db":
            say(dict(zip(("turns", "chunks"), engine.reredact(), strict=True)))
        elif args.command == "scan":
            if args.root:
                engine.config = dataclasses.replace(config, scanner=dataclasses.replace(config.scanner, root=args.root))
            say(Engine.as_json(engine.scan()))
        elif args.command == "parse":
            turns, chunks = engine.parse(args.path)
            say(f'{{"turns": {Engine.as_json(turns)}, "chunks": {Engine.as_json(chunks)}}}')
        else:
            rows = {"search": lambda: engine.search(args.query, args.limit, args.project), "sessions": lambda: engine.list_sessions(args.project, args.limit), "read": lambda: engine.read_session(args.session_id)}
            say(Engine.as_json(rows[args.command]()))
    except (ArgumentError, NotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(run())
