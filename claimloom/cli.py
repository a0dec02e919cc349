"""Command line: python -m claimloom.cli --root FOLDER ingest|link|show|stats|serve."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .api import Api, rows, serve
from .operators import linking, views
from .operators.store import Store
from .sources.files import landed_units
from .streaming.ingest import start


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="claimloom")
    p.add_argument("--root", required=True, help="folder of the layer's tables")
    sub = p.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest", help="take in landed answers")
    ingest.add_argument("answers", help="folder of JSON lines with the columns of a unit and its payload")
    ingest.add_argument("--pages", required=True, help="parquet table of page texts")
    ingest.add_argument("--documents", required=True, help="parquet table of documents: doc_id, principal_entity, published, fy_end_month")
    link = sub.add_parser("link", help="relate facts that are not related yet")
    link.add_argument("--rebuild", action="store_true", help="clear the relations first")
    show = sub.add_parser("show", help="print the most interesting relations")
    show.add_argument("--type", help="types, parted by commas")
    show.add_argument("--cross-document-only", action="store_true")
    show.add_argument("--limit", type=int, default=20)
    sub.add_parser("stats", help="print counts")
    web = sub.add_parser("serve", help="answer over HTTP")
    web.add_argument("--host", default="127.0.0.1")
    web.add_argument("--port", type=int, default=8000)
    return p


def run(spark: SparkSession, argv: list[str], out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    store = Store(spark, args.root)
    if args.command == "ingest":
        start(landed_units(spark, args.answers), store, spark.read.parquet(args.pages), spark.read.parquet(args.documents), f"{store.root}/checkpoint").awaitTermination()
        print(json.dumps({n: df.count() if (df := store.read(n)) is not None else 0 for n in ("facts", "relations", "failures")}), file=out)
    elif args.command == "link":
        if args.rebuild:
            print(json.dumps(Api(store).relink()), file=out)
        else:
            known = store.read("relations")
            report = rows(linking.link_report(store.read("facts"), known))[0]
            from pyspark.sql import functions as F

            store.add_relations(linking.link(store.read("facts"), known).withColumn("analysis", F.to_json("analysis")))
            print(json.dumps(report), file=out)
    elif args.command == "show":
        for r in rows(views.show(store.read("relations"), store.read("facts"), args.type, args.cross_document_only, args.limit)):
            print("\n".join(f"{k:>12}  {v}" for k, v in r.items()), end="\n\n", file=out)
    elif args.command == "stats":
        print(json.dumps(Api(store).stats(), indent=1), file=out)
    else:
        serve(Api(store), args.host, args.port).serve_forever()
    return 0


if __name__ == "__main__":
    session = SparkSession.builder.appName("claimloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    sys.exit(run(session, sys.argv[1:]))
