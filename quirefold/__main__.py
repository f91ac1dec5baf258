"""Command line: sort the pages of JSON request files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quirefold.config import for_language, overlay
from quirefold.operators import assemble
from quirefold.plans.request import respond
from quirefold.streaming.pages import REQUESTS


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quirefold")
    p.add_argument("requests", help="folder or file of JSON lines: page_id, engine, lines, input_json, page_width, page_height")
    p.add_argument("out", help="folder for the responses")
    p.add_argument("--language", default="english")
    p.add_argument("--set", default="", help="settings to change: field=value,...")
    p.add_argument("--format", choices=("json", "text"), default="json")
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    pages = respond(spark.read.schema(REQUESTS).json(args.requests), config=overlay(for_language(args.language), args.set))
    (assemble.write_json if args.format == "json" else assemble.write_text)(pages, args.out)


if __name__ == "__main__":
    main()
