"""Command line: python -m packlake COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from packlake import __version__, dims


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="packlake")
    parser.add_argument("--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments) -> argparse.ArgumentParser:
        made = commands.add_parser(name)
        made.add_argument("--repo", default=".")
        for flags, options in arguments:
            made.add_argument(*flags, **options)
        return made

    packing = [(("task",), {}), (("--budget",), {"type": int, "default": dims.DEFAULT_BUDGET}), (("--no-tests",), {"action": "store_true"}), (("--no-source",), {"action": "store_true"})]
    command("init", (("--force",), {"action": "store_true"}))
    command("scan", (("--max-files",), {"type": int, "default": 5000}))
    command("pack", *packing, (("--format",), {"default": "markdown"}), (("--compress",), {"default": "none"}), (("--out",), {}), (("--allow-sensitive",), {"action": "store_true"}))
    command("export", (("tool",), {}), *packing)
    command("list-files", (("task",), {}), (("--top",), {"type": int, "default": 20}))
    command("get-file", (("path",), {}))
    command("churn", (("--days",), {"type": int, "default": 30}), (("--top",), {"type": int, "default": 20}))
    command("memory", (("action",), {"choices": ["add", "decision", "list"]}), (("text",), {"nargs": "?", "default": ""}), (("--status",), {"default": "accepted"}))
    command("task", (("action",), {"choices": ["set", "show", "clear"]}), (("text",), {"nargs": "?", "default": ""}))
    args = parser.parse_args(argv)

    from packlake.api import Repository
    from packlake.operators.memory import Notebook
    from packlake.session import build_session

    try:
        if args.command in ("memory", "task"):
            from pathlib import Path

            notes = Notebook(Path(args.repo) / ".packlake")
            if args.command == "memory":
                {"add": lambda: notes.add(args.text), "decision": lambda: notes.decide(args.text, args.status), "list": lambda: print(notes.listed())}[args.action]()
            else:
                {"set": lambda: notes.set_task(args.text), "show": lambda: print(notes.shown_task()), "clear": notes.clear_task}[args.action]()
            return 0
        repo = Repository(build_session(), args.repo)
        if args.command == "init":
            print(repo.init(args.force))
        elif args.command == "scan":
            print(repo.scan(args.max_files).stats)
        elif args.command == "pack":
            print(repo.pack(args.task, args.budget, args.format, args.compress, out=args.out, include_tests=not args.no_tests, no_source=args.no_source, allow_sensitive=args.allow_sensitive))
        elif args.command == "export":
            print(repo.export(args.tool, args.task, args.budget, include_tests=not args.no_tests, no_source=args.no_source))
        elif args.command == "list-files":
            print(repo.list_files(args.task, args.top))
        elif args.command == "get-file":
            print(repo.get_file(args.path))
        else:
            print(repo.churn_report(args.days, args.top))
        return 0
    except (ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
