"""Command line: one document, an archive, or a batch with its deliverables."""

from __future__ import annotations

import argparse
import json
import os
import sys
import zipfile
from collections.abc import Sequence

from . import __version__

#: Changes of a corrected table that are printed.
SHOWN = 20

_SWITCHES = {
    "--json": "write objects, one to a line", "-q --quiet": "print no summary", "--batch": "make tables of all that lies under the paths", "--recognize": "find the columns that the documents have in common",
    "--no-text": "leave texts out of the results", "--no-copy-originals": "keep texts and hashes only", "--verify": "check the workspace against its hashes",
}
_FILES = {
    "--csv": ("FILE", "results"), "--exceptions": ("FILE", "what wasn't read, and why"), "--datasheet": ("FILE", "state of each input (.csv or .html)"), "--report": ("FILE", "review page (.html)"),
    "--workspace": ("FOLDER", "where documents and versions are kept"), "--import-csv": ("FILE", "file a corrected table as a revision of the workspace"),
}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioforge", description="Turns documents into tables.")
    p.add_argument("paths", nargs="*")
    p.add_argument("--version", action="version", version=__version__)
    for names, text in _SWITCHES.items():
        p.add_argument(*names.split(), help=text, action="store_true")
    for name, (kind, text) in _FILES.items():
        p.add_argument(name, help=text, metavar=kind)
    p.add_argument("--field", metavar="NAME=REGEX", default=[], action="append", help="a column of first matches")
    p.add_argument("--min-support", metavar="SHARE", default=0.5, type=float, help="of documents that must have a column found by --recognize")
    p.add_argument("--master", default=os.environ.get("SPARK_MASTER", "local[*]"))
    return p


def _session(master: str):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(master).appName("folioforge").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _say(*lines: str) -> None:
    print(*lines, sep="\n", file=sys.stderr)


def _single(args: argparse.Namespace) -> int:
    from .api import extract_archive, extract_file
    from .sources.limits import reason_of
    from .sources.sniff import office_format
    from .sinks.files import banner

    failed = 0
    many = len(args.paths) > 1

    def give(path: str, text: str, member: str | None = None, error: tuple[str, str] | None = None) -> None:
        nonlocal failed
        failed += error is not None
        if args.json:
            row = {"file": path} | ({"member": member} if member and not error else {}) | {"chars": len(text), "text": text}
            if error:
                row |= dict(zip(("reason", "detail"), error)) | ({"member": member} if member else {})
            print(json.dumps(row, ensure_ascii=False))
        elif not error:
            if many or member:
                print(banner(f"{path}!{member}" if member else path))
            print(text)
        if error:
            _say(f"folioforge: {path}{'!' + member if member else ''}: {': '.join(error)}")

    for path in args.paths:
        try:
            if os.path.isfile(path) and zipfile.is_zipfile(path) and not office_format(path):
                for member, text, error in extract_archive(path, require_text=True):
                    reason, _, detail = (error or "").partition(": ")
                    give(path, text, member, (reason, detail) if error else None)
            else:
                give(path, extract_file(path, require_text=True))
        except Exception as e:  # noqa: BLE001
            give(path, "", error=reason_of(e))
    return int(failed > 0)


def _workspace(args: argparse.Namespace) -> int:
    from .sinks.workspace import Workspace

    space = Workspace(args.workspace)
    if not space.exists():
        _say(f"{args.workspace} is no workspace")
        return 2
    spark = _session(args.master)
    if args.verify:
        problems, manifest = space.verify(spark), space.load()
        print(f"{len(manifest['documents'])} documents, {len(manifest['revisions'])} revisions: " + ("intact" if not problems else f"{len(problems)} problems"))
        print(*problems, sep="\n", end="\n" * bool(problems))
        return int(bool(problems))
    entry, encoding = space.import_csv(spark, args.import_csv)
    if entry is None:
        print(f"read as {encoding}; nothing is changed, so nothing was filed")
        return 0
    print(f"read as {encoding}; filed as revision {entry['revision']} with {entry['change_count']} changes")
    shown = entry["changes_from_previous"][:SHOWN]
    for change in shown:
        cell = f"{os.path.basename(change['file'] or '')} [{change['column']}]"
        print(f"  {cell} was {change['from']!r}, is {change['to']!r}")
    if rest := entry["change_count"] - len(shown):
        print(f"  {rest} further changes aren't shown")
    return 0


def _batch(args: argparse.Namespace) -> int:
    from .functions.fields import Field
    from .operators.tables import filled_columns, summary
    from .plans.batch import run
    from .sinks import files, pages
    from .sinks.workspace import Workspace

    try:
        fields = [Field.parse(f) for f in args.field]
    except ValueError as e:
        _say(str(e))
        return 2
    problems = [f"{p} doesn't exist" for p in args.paths if not os.path.exists(p)] + files.check_writable([args.csv, args.exceptions, args.datasheet, args.report])
    if problems:
        _say(*problems)
        return 2
    spark = _session(args.master)
    space = Workspace(args.workspace) if args.workspace else None
    if space and not space.exists():
        space.create(args.paths)
    done = run(spark, args.paths, fields, args.recognize, min_support=args.min_support, state=bool(args.datasheet or space), content=bool(space), include_text=True)
    if args.recognize and not args.quiet:
        for x in done.schema:
            _say(f"{x['label']:<28}{x['support']:>7}{100 * x['ratio']:>7.1f} %  {x['kind']:<12}{(x['example'] or '')[:40]}")
    table = done.results.drop("text") if args.no_text and "text" not in (*done.labels, *(f.name for f in fields)) else done.results
    if space:
        space.capture(done.extracted, not args.no_copy_originals)
        if not space.load()["revisions"]:
            space.add_revision(table, "first delivery")
        else:
            space.add_revision(table, "delivery", skip_if_unchanged=True)
    if args.csv:
        files.write_csv(table, args.csv)
    if args.exceptions:
        files.write_csv(done.exceptions.drop("files_not_read"), args.exceptions)
    else:
        for r in done.exceptions.select("file", "reason").toLocalIterator():
            _say(f"{r.file}: {r.reason}")
    if args.datasheet:
        if args.datasheet.lower().endswith((".html", ".htm")):
            pages.write_datasheet(done.datasheet, args.datasheet)
        else:
            files.write_csv(done.datasheet.select(*filled_columns(done.datasheet)), args.datasheet)
    if args.report:
        pages.write_review(done.results, done.exceptions, args.report)
    if args.json:
        files.write_json(table, sys.stdout)
    elif not args.quiet:
        s = summary(done.extracted).head()
        print(f"{s.n_read} read, {s.n_unread} not read, {s.characters:,} characters, {s.average:,} on average")
        print(files.shown(table))
    done.close()
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if args.verify or args.import_csv:
        if not args.workspace:
            parser.error("--verify and --import-csv need --workspace")
        return _workspace(args)
    if not args.paths:
        parser.error("nothing to read")
    if args.batch or any(map(os.path.isdir, args.paths)):
        return _batch(args)
    return _single(args)


if __name__ == "__main__":
    sys.exit(main())
