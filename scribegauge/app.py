"""Command line: ``score`` a sample set, ``inspect`` one sample."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators.lexicon import Lexicon
from .operators.scoring import Scorer
from .plans.evaluation import score_corpus
from .sources.datasets import load_samples, load_terminology
from .sources.reports import render_json


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scribegauge", description="Clinical transcript evaluation on Spark")
    top.add_argument("--version", action="version", version=f"scribegauge {__version__}")
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--dataset", required=True, help="JSON or JSONL samples")
    shared.add_argument("--terminology", help="JSON list of entries, or an object with entries and a version")
    shared.add_argument("--terminology-version")
    shared.add_argument("--annotation-guideline-version")
    commands = top.add_subparsers(dest="command", required=True)
    score = commands.add_parser("score", parents=[shared])
    score.add_argument("--output", help="path of the report; without it JSON goes to stdout")
    score.add_argument("--format", choices=("json", "csv"), help="default: by the suffix of the output")
    score.add_argument("--group-by", action="append", default=[], help="metadata field; repeatable")
    score.add_argument("--include-alignment", action="store_true")
    inspect = commands.add_parser("inspect", parents=[shared])
    inspect.add_argument("--sample-id", required=True)
    return top


def _scorer(spark: SparkSession, args: argparse.Namespace) -> Scorer:
    entries, version = None, args.terminology_version
    if args.terminology:
        entries, version = load_terminology(spark, args.terminology, version)
    return Scorer(
        recognizer=None if entries is None else Lexicon(entries),
        terminology_version=version, annotation_guideline_version=args.annotation_guideline_version,
    )


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    samples, scorer = load_samples(spark, args.dataset), _scorer(spark, args)
    if args.command == "inspect":
        samples = samples.where(F.col("sample_id") == args.sample_id)
        found = samples.limit(1000).count()
        if found != 1:
            raise ValueError(f"expected one sample with id {args.sample_id!r}; found {found}")
        print(score_corpus(samples, scorer).render(args.sample_id))
        return
    kind = args.format or ("csv" if (args.output or "").endswith(".csv") else "json")
    if kind == "csv" and not args.output:
        raise ValueError("CSV output needs --output")
    report = score_corpus(samples, scorer, include_alignment=args.include_alignment)
    for field in args.group_by:
        report.by_group(field)
    if kind == "csv":
        report.write_csv(args.output)
    elif args.output:
        report.write_json(args.output, args.include_alignment)
    else:
        print(render_json(report.to_dict(args.include_alignment)))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("scribegauge").getOrCreate()
    try:
        run(spark, args)
    except (OSError, ValueError, TypeError, KeyError, PySparkException) as error:
        print(f"scribegauge: {str(error).splitlines()[0] if str(error) else error!r}", file=sys.stderr)
        return 2
    return 0
