"""python -m palimpsest.cli [options] FILE|DIRECTORY|- ...: scan files and print one report for each.

Exit codes: 1 an error, 2 a finding at the threshold or above, 3 an incomplete scan, else 0.
"""

from __future__ import annotations

import argparse
import datetime
import os
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.evidence import MAX_BYTES, POWERPOINT
from .operators.findings import SEVERITIES, exit_codes
from .plans import render, scan

SUPPORTED = ("pdf", *POWERPOINT)
UNITS = {"": 1, "b": 1, "kb": 10**3, "kib": 1 << 10, "mb": 10**6, "mib": 1 << 20, "gb": 10**9, "gib": 1 << 30}
JOINS = {"markdown": "\n\n---\n\n", "text": "\n" + "=" * 72 + "\n\n", "html": "\n"}


def parse_size(raw: str) -> int:
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([a-z]*)", raw.strip().lower())
    if not m or m[2] not in UNITS:
        raise argparse.ArgumentTypeError(f"not a size: {raw}")
    return int(float(m[1]) * UNITS[m[2]])


def read_files(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """(name, content): named files whatever they are, of directories those with a supported extension, any case."""
    named = [p for p in paths if not os.path.isdir(p)]
    folders = [p for p in paths if os.path.isdir(p)]
    parts = []
    if named:
        parts.append(spark.read.format("binaryFile").load(named))
    if folders:
        # a subfolder named like a partition would be read as one
        deep = recursive or any("=" in e.name for p in folders for e in os.scandir(p) if e.is_dir())
        found = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).load(folders)
        if not recursive:
            found = found.where(F.regexp_replace("path", "^file:/*|/[^/]*$", "").isin(*[os.path.abspath(p).strip("/") for p in folders]))
        parts.append(found.where(F.lower(F.substring_index("path", ".", -1)).isin(*SUPPORTED)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.monotonically_increasing_id().cast("string").alias("file_id"), F.col("path").alias("name"), "content")


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    p.add_argument("paths", nargs="+", metavar="FILE")
    p.add_argument("-f", "--format", default="text", choices=["text", "json", "markdown", "html", "sarif"])
    p.add_argument("-o", "--output")
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("--fail-on", default="high", choices=[*SEVERITIES, "never"])
    p.add_argument("--max-size", type=parse_size, default=MAX_BYTES)
    p.add_argument("--stdin-name", default="stdin.pdf")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--no-color", action="store_false", dest="color")
    p.add_argument("-v", "--version", action="version", version=render.VERSION)
    a = p.parse_args(argv)
    if a.format == "html" and a.output and len(a.paths) > 1:
        p.error("HTML output takes one input")
    return a


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = arguments(sys.argv[1:] if argv is None else argv)
    except SystemExit as e:
        return 1 if e.code else 0
    spark = spark or SparkSession.builder.appName("palimpsest").getOrCreate()
    paths = [p for p in a.paths if p != "-"]
    try:
        if missing := [p for p in paths if not os.path.exists(p)]:
            raise FileNotFoundError(", ".join(missing))
        files = read_files(spark, paths, a.recursive) if paths else None
        if "-" in a.paths:
            given = spark.createDataFrame([("-", a.stdin_name, sys.stdin.buffer.read())], "file_id string, name string, content binary")
            files = files.unionByName(given) if files is not None else given
        done = scan.scan(files, a.max_size)
        now = datetime.datetime.now(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        full = render.full_reports(done, now).persist()
        code = exit_codes(full, a.fail_on).first()["exit_code"]
        if a.format == "sarif":
            out = render.sarif(done)
        else:
            quiet = "painted" if a.color and not a.output and sys.stdout.isatty() else "quiet"
            form = quiet if a.quiet and a.format == "text" else a.format
            rows = [r["report"] for r in full.orderBy("name", "file_id").select(render.FORMATS[form]().alias("report")).toLocalIterator()]
            if form == "json":
                out = render.json_document(rows)
            else:
                out = JOINS.get(form, "\n").join(rows[:1] if form == "html" else rows) + ("\n" if form in ("quiet", "painted") else "")
        full.unpersist()
        done.release()
    except Exception as e:  # noqa: BLE001  any failure is an execution error to the caller
        print(f"error: {e}", file=sys.stderr)
        return 1
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(out)
    else:
        sys.stdout.write(out)
    return code


if __name__ == "__main__":
    sys.exit(main())
