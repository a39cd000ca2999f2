"""Sync, inspect and search an index: spark-submit cli.py <command> [options]."""

from __future__ import annotations

import argparse
import json

from lodestone.config import RetrievalOptions
from lodestone.plans.index import CHUNKERS, EvidenceIndex, IndexProfile
from lodestone.plans.search import SearchEngine
from lodestone.session import build_session
from lodestone.sources.embedding import HttpEmbeddings
from lodestone.sources.markdown import parse_sources, scan_markdown


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--index", required=True, help="index folder")
    parser.add_argument("--chunker", default="structure", choices=sorted(CHUNKERS))
    parser.add_argument("--embedding", help="JSON object with the fields of HttpEmbeddings")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("sync", "status"):
        one = commands.add_parser(name)
        one.add_argument("--collection", action="append", default=[], metavar="ID=FOLDER", required=name == "sync")
        one.add_argument("--include", action="append")
        one.add_argument("--exclude", action="append")
    search = commands.add_parser("search")
    search.add_argument("--requests", required=True, help="JSON file with a list of search requests")
    search.add_argument("--mode", default="bm25", choices=("bm25", "dense", "hybrid"))
    args = parser.parse_args()

    spark = build_session("lodestone")
    provider = HttpEmbeddings(**json.loads(args.embedding)) if args.embedding else None
    index = EvidenceIndex(spark, args.index, IndexProfile(args.chunker))

    def scan():
        out = None
        for pair in args.collection:
            name, folder = pair.split("=", 1)
            one = parse_sources(scan_markdown(spark, folder, name, args.include, args.exclude))
            out = one if out is None else out.unionByName(one)
        return out

    if args.command == "sync":
        print(json.dumps(index.sync(scan(), provider, rescan=scan)))
    elif args.command == "status":
        key = index.profile.vector_key(provider) if provider else None
        print(json.dumps(index.status(scan() if args.collection else None, "hybrid" if provider else "bm25", key)))
    else:
        with open(args.requests, encoding="utf-8") as handle:
            requests = json.load(handle)
        engine = SearchEngine(index, provider, RetrievalOptions(mode=args.mode))
        for row in engine.search(requests).orderBy("request_id").toLocalIterator():
            print(row["response"] or json.dumps({"status": "error", "code": row["error"]}))


if __name__ == "__main__":
    main()
