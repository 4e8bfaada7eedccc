"""Command line: ``python -m tessera.cli book.epub -o out``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .extract import extract_epub
from .operators.book import Config


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tessera", description="Extract the text of an EPUB, chapter by chapter.")
    parser.add_argument("epub_path", help="the .epub file")
    parser.add_argument("-o", "--output", default="output", help="folder for the text files (default: output)")
    parser.add_argument("--keep-furigana", action="store_true", help="keep ruby readings, as base(reading)")
    parser.add_argument("--single-file", action="store_true", help="write all items into one file")
    parser.add_argument("--keep-scene-markers", action="store_true", help="keep paragraphs that are only a divider")
    parser.add_argument("--flat", action="store_true", help="do not tell chapters from other items")
    return parser.parse_args(args)


def config(a: argparse.Namespace) -> Config:
    return Config(keep_reading=a.keep_furigana, single_file=a.single_file, keep_markers=a.keep_scene_markers, detect_chapters=not a.flat)


def main(args: list[str] | None = None) -> int:
    a = arguments(args)
    if not os.path.isfile(a.epub_path):
        print(f"File not found: {a.epub_path}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    extract_epub(spark, a.epub_path, a.output, config(a))
    return 0


if __name__ == "__main__":
    sys.exit(main())
