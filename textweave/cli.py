"""Command line: build, search and validate an index folder."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from textweave.operators.search import hits_json, search
from textweave.plans.options import SearchOptions
from textweave.sources.jsonl import read_jsonl
from textweave.sources.segments import build_segment, open_index, validate_root, validate_segment


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textweave")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("corpus")
    build.add_argument("root")
    build.add_argument("--segment-name")
    find = commands.add_parser("search")
    find.add_argument("root")
    find.add_argument("--query", required=True)
    find.add_argument("--topk", type=int, default=20)
    find.add_argument("--min-hits", type=int, default=2)
    find.add_argument("--normalized", action="store_true", help="the query is normalised already")
    check = commands.add_parser("validate")
    check.add_argument("root")
    check.add_argument("--segment")
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "build":
        print(json.dumps(build_segment(spark, read_jsonl(spark, a.corpus), a.root, a.segment_name)))
        return 0
    if a.command == "search":
        options, index = replace(SearchOptions(), topk=a.topk, min_hits=a.min_hits), open_index(spark, a.root)
        row = None
        if index:
            queries = spark.createDataFrame([(0, a.query)], "qid long, text string")
            row = hits_json(search(index[0], index[1], queries, options, a.normalized, index[2])).first()
        print(json.dumps({"query": a.query, "segments_scanned": index[3] if index else 0, "hits": json.loads(row["result"]) if row else []}, ensure_ascii=False))
        return 0
    errors = validate_segment(spark, a.root, a.segment) if a.segment else validate_root(spark, a.root)["errors"]
    print(json.dumps({"ok": not errors, "errors": errors}))
    return 2 if errors else 0


if __name__ == "__main__":
    sys.exit(main())
