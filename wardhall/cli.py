"""Command line: validate, build, attach, migrate, detach, diff, inspect, erase, sweep, purge, query, ask, version."""

from __future__ import annotations

import argparse
import sys

VERSION = "0.1.0"


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("wardhall").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wardhall", description="Governed tables on Spark.")
    sub = p.add_subparsers(dest="command", required=True)

    def add(command: str, /, *names: str, **more: dict) -> argparse.ArgumentParser:
        c = sub.add_parser(command)
        for n in names:
            c.add_argument(n)
        for n, kw in more.items():
            c.add_argument(f"--{n.replace('_', '-')}", **kw)
        return c

    store, out = {"required": True}, {"default": "out"}
    add("version")
    add("help")
    add("validate", "specification")
    add("diff", "before", "after", output={"default": None})
    add("inspect", store={"default": None}, jdbc={"default": None}, owner={"default": None}, name={"default": "store"}, output={"default": None})
    for name in ("build", "migrate"):
        add(name, "specification", store=store, profile={"default": "default"}, output=out)
    add("attach", store=store, principal={"required": True}, profile={"default": "default"}, output=out, artifact={"default": None})
    add("detach", store=store, principal={"required": True}, history={"choices": ["keep", "drop"], "default": None}, yes={"action": "store_true"})
    add("erase", store=store, principal={"default": None}, column={"action": "append", "default": []}, value={"action": "append", "default": []}, check={"action": "store_true"}, apply={"action": "store_true"}, output={"default": None})
    add("sweep", store=store, principal={"required": True})
    add("purge", output=out, yes={"action": "store_true"})
    add("update", store=store)
    add("query", "text", store=store, principal={"required": True}, limit={"type": int, "default": 50})
    add("ask", "question", store=store, principal={"required": True}, model={"required": True, "help": "a program that reads instructions and a question, as JSON, and prints its answer"}, yes={"action": "store_true"}, words={"action": "store_true"}, limit={"type": int, "default": 50})
    return p


def _model(command: str):
    """A program as the model that writes queries: it gets {"instructions", "question"} and prints the answer."""
    import json
    import shlex
    import subprocess

    from .model import GovernanceError

    def generate(instructions: str, question: str) -> str:
        done = subprocess.run(shlex.split(command), input=json.dumps({"instructions": instructions, "question": question}), capture_output=True, text=True, check=False)
        if done.returncode:
            raise GovernanceError(f"the model ended with {done.returncode}: {done.stderr.strip()[:200]}")
        return done.stdout

    return generate


def _agreed(query: str, yes: bool) -> bool:
    """Shows the query before it runs; whether it may."""
    print(query)
    return yes or input("run this? [y/N] ").strip().lower() in ("y", "yes")


def _emit(text: str, path: str | None) -> None:
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from .model import GovernanceError

    try:
        return _run(args)
    except GovernanceError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(args: argparse.Namespace) -> int:
    from .model import GovernanceError
    from .operators.diff import diff, render
    from .sources import artifact, spec
    from .validate import validate

    if args.command == "version":
        print(VERSION)
    elif args.command == "help":
        parser().print_help()
    elif args.command == "validate":
        validate(spec.load(args.specification))
        print("valid")
    elif args.command == "diff":
        _emit(render(diff(spec.load(args.before), spec.load(args.after))), args.output)
    elif args.command == "purge":
        print("purged" if artifact.purge(args.output, args.yes) else "nothing purged")
    elif args.command == "inspect" and args.jdbc:
        from .sources import information_schema

        _emit(spec.dumps(information_schema.inspect_database(information_schema.jdbc(_spark(), args.jdbc), args.name, args.owner)), args.output)
    elif not args.store:
        raise GovernanceError("give a store or a database")
    else:
        from .engine import Engine, result_json

        engine = Engine(_spark(), args.store, principal=getattr(args, "principal", None))
        if args.command == "inspect":
            from .sources.catalog import inspect_store

            _emit(spec.dumps(inspect_store(engine.store, args.name, args.owner)), args.output)
        elif args.command in ("build", "migrate"):
            print(getattr(engine, args.command)(spec.load(args.specification), args.output, args.profile))
        elif args.command == "attach":
            path = args.artifact or artifact.latest(args.output, args.profile)
            if path is None:
                raise GovernanceError("no artifact")
            print(f"build {engine.attach(path)}")
        elif args.command == "detach":
            engine.detach(args.history, args.yes)
            print("detached")
        elif args.command == "erase":
            if args.check == args.apply or not args.column or len(args.column) != len(args.value):
                raise GovernanceError("give --check or --apply, and as many values as columns")
            rows = [r.asDict() for r in engine.erase_check(args.column, args.value).collect()] if args.check else engine.erase_apply(args.column, args.value)
            _emit(result_json(rows), args.output)
        elif args.command == "sweep":
            print(result_json(engine.sweep()))
        elif args.command == "update":
            engine.update_meta()
            print("metadata is up to date")
        elif args.command == "query":
            engine.sql(args.principal, args.text).show(args.limit, truncate=False)
        elif args.command == "ask":
            from . import nlq

            generate = _model(args.model)
            query, rows = nlq.ask(engine, args.principal, args.question, generate)
            if _agreed(query, args.yes):
                rows.show(args.limit, truncate=False)
                if args.words:
                    print(nlq.interpret(args.question, rows, generate, args.limit))
    return 0


if __name__ == "__main__":
    sys.exit(main())
