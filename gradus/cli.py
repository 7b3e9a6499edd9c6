"""Command line: ``python -m gradus.cli build | summarize | judge | report``."""

from __future__ import annotations

import argparse
import importlib
import json
import os
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from gradus.functions import prompts
from gradus.operators import collection, judging
from gradus.plans import report
from gradus.sources import tables, trec

METHODS = ("probabilistic", "structured")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gradus", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="tables from a query file, a judgment file and corpus shards")
    build.add_argument("queries")
    build.add_argument("qrels")
    build.add_argument("shards", nargs="+")
    build.add_argument("--collection", required=True)
    build.add_argument("--revision", help="publish the tables under this name")
    build.add_argument("--cache-dir", help="keep the passages here, by the digest of the judgment file")
    build.add_argument("--check-offsets", action="store_true", help="passages must stand where their ids say")
    build.add_argument("--fetch-from", help="a folder that executors see, from which the two metadata files are copied to the cache if they aren't there")
    build.add_argument("--seek", action="store_true", help="look passages up where their ids say, and scan no shard")
    summarize = commands.add_parser("summarize", help="counts and lengths of a collection")
    summarize.add_argument("--collection", required=True)
    summarize.add_argument("--revision", help="a published revision of the tables")
    summarize.add_argument("--json", action="store_true")
    for name, words in (("judge", "judge what the checkpoint lacks, then report"), ("report", "report a complete checkpoint")):
        own = commands.add_parser(name, help=words)
        own.add_argument("--collection", required=True)
        own.add_argument("--revision", help="a published revision of the tables")
        own.add_argument("--data-dir", required=True)
        own.add_argument("--method", choices=METHODS, default="probabilistic")
        own.add_argument("--runs", help="folder of run files; DATA_DIR/runs by default")
        own.add_argument("--fetch-from", help="a folder that executors see, whose run files are copied to the folder of runs and checked")
        own.add_argument("--local-runs", action="store_true", help="fetch nothing; only files that are there")
        own.add_argument("--download-only", action="store_true", help="fetch and check the run files, then stop")
        if name == "judge":
            own.add_argument("--judge", default="gradus.operators.judging:stub", help="module:factory of the judge")
            own.add_argument("--model", default="stub")
            own.add_argument("--concurrency", type=int, default=16, help="partitions")
            own.add_argument("--threads", type=int, default=1, help="requests at a time of each partition")
            own.add_argument("--reasoning-effort", choices=prompts.EFFORTS)
            own.add_argument("--rpm", type=int)
            own.add_argument("--tpm", type=int)
            own.add_argument("--one-rate", action="store_true", help="partitions lease shares of the rates from each other; all must run at a time")
    return top


def parse(argv: Sequence[str] | None = None) -> argparse.Namespace:
    top = parser()
    args = top.parse_args(argv)
    if args.command in ("judge", "report") and args.local_runs and (args.fetch_from or args.download_only):
        top.error("with --local-runs there is nothing to fetch")
    if args.command == "build" and args.fetch_from and not args.cache_dir:
        top.error("what is fetched needs a cache")
    if args.command == "judge":
        if args.method != "structured" and (args.one_rate or any(x is not None for x in (args.reasoning_effort, args.rpm, args.tpm))):
            top.error("only the structured method has an effort and rates")
        if any(x is not None and x <= 0 for x in (args.rpm, args.tpm)):
            top.error("a rate must be over 0")
        if min(args.concurrency, args.threads) < 1:
            top.error("there must be a partition and a thread at least")
    return args


def configuration(args: argparse.Namespace) -> dict:
    """What an experiment's signature depends on; concurrency and rate limits don't count."""
    # The names and versions that experiments are told apart by.
    if args.method == "probabilistic":
        return {"decision": "argmax_probability_lower_grade_on_tie"}
    return {
        "decision": "structured_grade", "reasoning_effort": args.reasoning_effort or "none", "prompt": prompts.numbered_instructions(), "input_format": "query_passage_json_v1",
        "output_schema": prompts.ANSWER_SCHEMA, "truncation": {"character_budget": prompts.CHARACTER_BUDGET, "margin": prompts.MARGIN},
    }


def pace(args: argparse.Namespace) -> Callable[[], judging.Pace]:
    """A structured judge's budgets, split evenly over the partitions, whose paces don't meet, or one for all; a probabilistic one has none."""
    if args.method == "probabilistic":
        return judging.Pace
    rpm, tpm = args.rpm or prompts.REQUESTS_PER_MINUTE, args.tpm or prompts.TOKENS_PER_MINUTE
    if args.one_rate:
        return lambda: judging.SharedPace(rpm, tpm)
    return lambda: judging.Pace(rpm / args.concurrency, tpm / args.concurrency)


def factory(args: argparse.Namespace) -> Callable[[], judging.Judge]:
    module, _, name = args.judge.partition(":")
    return getattr(importlib.import_module(module), name)


def run_files(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """The checked run files, fetched first if a folder to fetch from is named."""
    folder = args.runs or os.path.join(args.data_dir, "runs")
    if args.fetch_from and not args.local_runs:
        names = [os.path.basename(p) for p in trec.run_paths(args.fetch_from)]
        trec.cached_runs(spark, folder, names, tables.copied(args.fetch_from))
    paths = trec.run_paths(folder)
    trec.read_runs(spark, paths)
    return paths


def main(argv: Sequence[str] | None = None) -> None:
    args = parse(argv)
    spark = SparkSession.builder.appName("gradus").getOrCreate()
    if args.command == "build":
        named = [args.queries, args.qrels]
        if args.fetch_from:
            named = tables.cached_files(spark, args.cache_dir, [os.path.basename(n) for n in named], tables.copied(args.fetch_from), lambda _: None)
        made = collection.build(spark, *named, args.shards, cache=args.cache_dir, check_offsets=args.check_offsets, seek=args.seek)
        tables.write_collection(made, args.collection, args.revision)
        return
    if args.command == "summarize":
        found = collection.summarize(**tables.read_collection(spark, args.collection, args.revision))
        print(json.dumps(found, indent=2) if args.json else collection.as_text(found))
        return
    paths = run_files(spark, args)
    if args.download_only:
        print(f"{len(paths)} run files are there and fine")
        return
    known = tables.read_collection(spark, args.collection, args.revision)
    folder = f"{args.data_dir}/{args.method}"
    if args.command == "judge":
        judging.run(spark, known, folder, factory(args), model=args.model, concurrency=args.concurrency, threads=args.threads, configuration=configuration(args), pace=pace(args))
    found = report.report_only(spark, args.data_dir, args.method, known["qrels"], paths)
    print(json.dumps({k: found[k] for k in ("usage", "cost", "agreement", "system_rank_correlations")}, indent=2))
    print(f"The whole report is in {folder}/results.json")


if __name__ == "__main__":
    main()
