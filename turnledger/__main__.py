"""The batch jobs from the command line.

    spark-submit … turnledger/__main__.py preprocess s3a://bucket/raw.json s3a://bucket/out
    python -m turnledger train out --folds 3 --events events
    python -m turnledger run raw.json out --events events

Everything below the output folder has a fixed name: processed, sample, stats, models,
evaluation, report. With `--events` documents about the job are appended to the event
table; `run` adds documents about the run and each of its stages.
"""

from __future__ import annotations

import argparse
import time
import traceback
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnledger import constants as K
from turnledger.operators import events as ev
from turnledger.plans.cost_report import cost_report
from turnledger.plans.preprocess import preprocess
from turnledger.plans.train import train
from turnledger.sources import event_store, tables
from turnledger.sources.conversations import json_array_to_jsonl

SAMPLE_CONVERSATIONS = 50_000


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    events = argparse.ArgumentParser(add_help=False)
    events.add_argument("--events", help="root of the event table")
    pre_options = argparse.ArgumentParser(add_help=False)
    pre_options.add_argument("--sample", action="store_true", help="a sample of the conversations only")
    pre_options.add_argument("--sample-size", type=int, default=SAMPLE_CONVERSATIONS)
    fit_options = argparse.ArgumentParser(add_help=False)
    fit_options.add_argument("--folds", type=int, default=3)
    fit_options.add_argument("--no-leak", action="store_true", help="leave out the feature that is the label")
    cost_options = argparse.ArgumentParser(add_help=False)
    cost_options.add_argument("--model", default=K.DEFAULT_PRICE_MODEL, choices=list(K.PRICES))

    parser = argparse.ArgumentParser(prog="turnledger")
    jobs = parser.add_subparsers(dest="job", required=True)
    convert = jobs.add_parser("convert", help="JSON array files to JSON lines")
    convert.add_argument("source")
    convert.add_argument("target")
    convert.add_argument("--limit", type=int)
    pre = jobs.add_parser("preprocess", parents=[pre_options, events], help="conversations to processed turns")
    fit = jobs.add_parser("train", parents=[fit_options, events], help="fit the token models")
    cost = jobs.add_parser("cost", parents=[cost_options, events], help="cost report")
    run = jobs.add_parser("run", parents=[pre_options, fit_options, cost_options, events],
                          help="the three jobs above in a row")
    run.add_argument("--skip", action="append", default=[], choices=list(JOBS))
    for job in (pre, run):
        job.add_argument("source")
    for job in (pre, fit, cost, run):
        job.add_argument("out")
    return parser.parse_args(argv)


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _record(docs: DataFrame, prefix: str, root: str | None) -> None:
    if root is not None:
        event_store.append(event_store.documents(docs, prefix), root)


def _preprocess(spark: SparkSession, args: argparse.Namespace, out: str) -> None:
    started, at = time.perf_counter(), _now()
    stats = preprocess(
        spark, args.source, f"{out}/processed", f"{out}/sample", f"{out}/stats",
        args.sample_size if args.sample else None,
    )
    stats.show(vertical=True)
    doc = ev.processing_document(
        stats, "total_turns", "preprocess", time.perf_counter() - started, at
    )
    _record(doc.withColumn("sample_mode", F.lit(args.sample)), "events", args.events)


def _train(spark: SparkSession, args: argparse.Namespace, out: str) -> None:
    at = _now()
    features = K.NO_LEAK_COLUMNS if args.no_leak else K.FEATURE_COLUMNS
    best, metrics = train(spark, f"{out}/processed", f"{out}/models", features, args.folds)
    tables.write_json(metrics.withColumn("best", F.col("model_name") == best), f"{out}/evaluation")
    metrics.show(truncate=False)
    _record(ev.training_documents(metrics, at), "metrics", args.events)
    _record(ev.training_summary_document(metrics, best, at), "events", args.events)


def _cost(spark: SparkSession, args: argparse.Namespace, out: str) -> None:
    started, at = time.perf_counter(), _now()
    report = cost_report(spark, f"{out}/processed", f"{out}/report", args.model)
    report.totals.show(vertical=True)
    report.model_comparison.show(truncate=False)
    doc = ev.processing_document(
        report.totals, "total_conversations", "cost_analysis", time.perf_counter() - started, at
    )
    _record(doc.withColumn("model", F.lit(args.model)), "events", args.events)
    _record(ev.cost_document(report.totals, args.model, at), "events", args.events)


JOBS = {"preprocess": _preprocess, "train": _train, "cost": _cost}


def _run(spark: SparkSession, args: argparse.Namespace, out: str) -> None:
    """All jobs. One that fails is recorded and the next one still has its turn, on what
    an earlier run may have left; the exit code tells."""
    run_id, started = uuid.uuid4().hex, time.perf_counter()
    _record(ev.run_started_document(spark, run_id, _now()), "events", args.events)
    errors: dict[str, str | None] = {}
    for stage in [job for job in JOBS if job not in args.skip]:
        try:
            JOBS[stage](spark, args, out)
            errors[stage] = None
        except Exception as error:
            traceback.print_exc()
            errors[stage] = str(error)
        _record(ev.stage_document(spark, run_id, stage, errors[stage], _now()), "events", args.events)
    seconds = time.perf_counter() - started
    _record(ev.run_completed_document(spark, run_id, errors, seconds, _now()), "events", args.events)
    if any(error is not None for error in errors.values()):
        raise SystemExit(1)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _arguments(argv)
    spark = spark or SparkSession.builder.appName(f"turnledger-{args.job}").getOrCreate()
    if args.job == "convert":
        print(json_array_to_jsonl(spark, args.source, args.target, args.limit), "records")
    else:
        (JOBS | {"run": _run})[args.job](spark, args, args.out.rstrip("/"))


if __name__ == "__main__":
    main()
