"""python -m cloakframe COMMAND: anonymise files, publish them by labels, restore them. Under spark-submit the session is the cluster's."""

from __future__ import annotations

import argparse
import getpass
import os
import sys

from pyspark.sql import SparkSession

from .functions.styles import STYLES
from .plans import files
from .sources import files as formats
from .sources.mapping_store import WrongPassword


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="cloakframe", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("anonymise", "each file by itself"), ("case", "all files as one case, with one mapping"), ("publish", "by labels, without a mapping"), ("restore", "values back into files")):
        c = commands.add_parser(name, help=text)
        c.add_argument("path", help="a file or a folder")
        c.add_argument("folder", help="where results go")
        if name == "restore":
            c.add_argument("mapping", help="the encrypted mapping")
            continue
        c.add_argument("--categories", nargs="+")
        c.add_argument("--names", help="a list of first names, a line each")
        c.add_argument("--surnames")
        c.add_argument("--cities")
        c.add_argument("--no-page-numbers", action="store_true", help="drop lines of page numbers")
        c.add_argument("--keep-layout", action="store_true", help="replace inside the runs of DOCX files")
        if name != "publish":
            c.add_argument("--style", choices=STYLES, default="pelny_token")
            c.add_argument("--prompt", action="store_true", help="put the list of placeholders before each text")
            c.add_argument("--report", action="store_true")
    commands.add_parser("formats", help="which formats can be read here")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    if args.command == "formats":
        for name, ok in sorted(formats.readable().items()):
            print(f"{name}: {'yes' if ok else 'no, its engine is missing'}")
        return 0
    spark = SparkSession.builder.appName("cloakframe").getOrCreate()
    password = lambda: os.environ.get("CLOAKFRAME_PASSWORD") or getpass.getpass("Password: ")
    if args.command == "restore":
        try:
            done = files.restore_files(spark, args.path, args.mapping, password(), args.folder)
        except WrongPassword as e:
            print(e, file=sys.stderr)
            return 2
    else:
        lists = [formats.dictionary(spark, p, kind, "pl") for kind, p in (("first_name", args.names), ("surname", args.surnames), ("city", args.cities)) if p]
        dictionary = None
        for one in lists:
            dictionary = one if dictionary is None else dictionary.unionByName(one)
        published = args.command == "publish"
        out = files.anonymise_files(
            spark, args.path, args.folder, None if published else password(), args.command == "case", categories=args.categories, page_numbers=not args.no_page_numbers,
            keep_layout=args.keep_layout, published=published, dictionary=dictionary, **({} if published else {"style": args.style, "prompt": args.prompt, "report": args.report}),
        )
        done = [*out.files, *out.mappings, *out.reports]
        for category, n in sorted(out.counts.items()):
            print(f"{category}: {n}")
    for r in done:
        print(f"{r['name']}: {r['error'] or f'{r["bytes"]} bytes'}")
    return 1 if any(r["error"] for r in done) else 0


if __name__ == "__main__":
    sys.exit(main())
