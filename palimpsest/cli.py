"""Command line: ``python -m palimpsest.cli --store DIR COMMAND``; results are JSON lines."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import providers
from .api import Api, serve_tools, server
from .functions.embedding import hashed
from .functions.text import preview
from .operators import history, sessions, stats
from .service import Engine
from .sources import backup, files, spool
from .store import Store
from .streaming.ingest import drain

COMMANDS = {
    "list": "", "show": "path", "search": "prompt", "recall": "prompt", "history": "path", "audit": "", "pending": "", "approve": "path", "reject": "path",
    "supersede": "winner loser", "flag": "a b", "auto-resolve": "", "ingest": "spool", "write-event": "spool json", "sessions": "", "session": "key", "stats": "",
    "patterns": "", "archive": "days", "unarchive": "path", "backup": "folder", "restore": "folder", "rehearse-restore": "folder", "edit": "path content", "delete": "path",
    "propose": "path content", "render": "file", "health": "", "diff": "path",
    "render-to": "folder target", "as-of": "path at", "promote": "pattern", "embed-backfill": "", "reindex": "model dim", "consolidate": "", "migrate": "", "eval-retrieval": "file", "log": "file", "serve": "port", "tools": "",
    "distill": "provider model", "check-contradictions": "provider model", "restore-file": "file", "vacuum": "", "patterns-since": "age",
}

#: Options by command: their names, and what argparse is told of them.
OPTIONS = {
    "list": {"kind": {}, "project": {}, "since": {"help": "36h, 7d or 30m"}, "limit": {"type": int, "default": 0}, "include-archived": {"action": "store_true"}},
}


def joined(a: str, b: str) -> tuple[str, str]:
    """The merge of two notes that needs no model: both bodies, one after the other."""
    return f"general/merged-{hashlib.sha1(f'{a}|{b}'.encode()).hexdigest()[:6]}.md", f"{a}\n\n{b}"


def listed(engine: Engine, kind=None, project=None, since=None, limit=0, include_archived=False):
    """Paths with the first lines of their notes."""
    rows = engine.listed(kind, project, since, limit, include_archived)
    return rows.select("path", "project", "status", "updated_at", preview(F.col("content"), 50).alias("preview"))


def run(spark: SparkSession, root: str, command: str, args: list[str], **options):
    store = Store(spark, root)
    engine = Engine(store, embed=hashed)
    read = store.read
    versions = engine.versions
    table = {
        "list": lambda **o: listed(engine, **o),
        "show": lambda path: read("memory").where(F.col("path") == path),
        "search": lambda prompt: engine.recall(prompt),
        "recall": lambda prompt: engine.recall(prompt),
        "history": lambda path: versions().where(F.col("path") == path),
        "diff": lambda path: history.diffs(versions().where(F.col("path") == path)),
        "audit": lambda: history.recent(read("memory_revision")),
        "pending": lambda: history.pending(read("memory")).select("path", "updated_at"),
        "approve": lambda path: engine.transition("approve", path),
        "reject": lambda path: engine.transition("reject", path),
        "supersede": engine.supersede, "flag": engine.flag, "auto-resolve": engine.auto_resolve,
        "ingest": lambda folder: drain(spark, folder, store, f"{root}/_checkpoint", f"{root}/_dlq"),
        "write-event": lambda folder, text: spool.append(folder, json.loads(text), engine.now[:10]),
        "sessions": lambda: sessions.with_counts(read("session"), read("event")).orderBy(F.desc("created_at"), "session_key").limit(20),
        "session": lambda key: sessions.walk(read("event"), key),
        "stats": lambda: stats.everything(read("memory"), read("session"), read("event")),
        "patterns": engine.patterns, "patterns-since": engine.patterns, "vacuum": store.vacuum,
        "distill": lambda name, model: engine.distill(providers.chosen(providers.DISTILLERS, name)(model), name, model),
        "check-contradictions": lambda name, model: engine.check_contradictions(providers.judging(providers.chosen(providers.JUDGES, name)(model))),
        "restore-file": lambda file: backup.restore_file(store, file),
        "promote": engine.promote, "as-of": engine.as_of, "migrate": engine.migrate,
        "embed-backfill": lambda: engine.backfill_embeddings("hashed", 64),
        "reindex": lambda model, dim: engine.backfill_embeddings(model, int(dim)),
        "consolidate": lambda: engine.consolidate(joined),
        "eval-retrieval": lambda file: engine.evaluate([(x["query"], x["path"]) for x in map(json.loads, open(file, encoding="utf-8"))]),
        "render-to": lambda folder, target: files.write_rendered(engine, folder, target),
        "log": lambda file: files.log_tail(spark, file),
        "serve": lambda port: server(Api(engine), port=int(port)).serve_forever(),
        "tools": lambda: serve_tools(Api(engine)),
        "archive": lambda days: engine.archive(int(days)),
        "unarchive": lambda path: engine.set_archived([path], False),
        "backup": lambda folder: backup.backup(store, folder),
        "restore": lambda folder: backup.restore(store, folder),
        "rehearse-restore": lambda folder: backup.rehearse(store, f"{folder}/backup", Store(spark, f"{folder}/scratch")),
        "edit": engine.edit, "delete": engine.delete, "propose": engine.propose,
        "render": lambda file: engine.rendered(open(file, encoding="utf-8").read()),
        "health": lambda: stats.health(read("memory"), sessions.undreamed(read("session"), read("event")), read("rehearsal_run"), engine.now, dlq=spool.dead_count(spark, f"{root}/_dlq")),
    }
    return table[command](*args, **options)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="palimpsest")
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in COMMANDS.items():
        s = sub.add_parser(name)
        for a in args.split():
            s.add_argument(a)
        for option, told in OPTIONS.get(name, {}).items():
            s.add_argument(f"--{option}", **told)
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = run(spark, a.store, a.command, [getattr(a, x) for x in COMMANDS[a.command].split()], **{x: getattr(a, x) for x in (o.replace("-", "_") for o in OPTIONS.get(a.command, {}))})
    for row in out.toJSON().toLocalIterator() if hasattr(out, "toJSON") else [json.dumps(out, default=str)]:
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
