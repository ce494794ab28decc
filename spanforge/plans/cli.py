"""Command line: analyze, report, compare, list, watch, validate."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from spanforge import __version__
from spanforge.operators.intents import STRATEGIES
from spanforge.plans import analyze, report
from spanforge.plugins import REGISTRY, Config, parse_cost_model, parse_weights
from spanforge.sources import transcripts


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanforge")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("analyze")
    one.add_argument("path")
    one.add_argument("--group", action="store_true")
    one.add_argument("-o", "--output", help="a new folder for reports of all sessions, written by tasks; format json, text or markdown")
    one.add_argument("--quick", action="store_true", help="by keywords, tolerant of broken lines")
    rep = sub.add_parser("report")
    rep.add_argument("path")
    rep.add_argument("-o", "--output")
    cmp_ = sub.add_parser("compare")
    cmp_.add_argument("paths", nargs="+")
    cmp_.add_argument("--sort", choices=("ter", "tokens", "waste"), default="ter")
    cmp_.add_argument("--baseline", action="store_true")
    ls = sub.add_parser("list")
    ls.add_argument("path")
    ls.add_argument("--limit", type=int, default=20)
    val = sub.add_parser("validate")
    val.add_argument("path")
    live_ = sub.add_parser("watch")
    live_.add_argument("path")
    live_.add_argument("--checkpoint", required=True)
    live_.add_argument("--interval", default="2 seconds")
    live_.add_argument("--once", action="store_true")
    live_.add_argument("--dashboard", action="store_true", help="totals of all sessions after each batch")
    live_.add_argument("--idle-minutes", type=float, help="with --dashboard: sessions that are silent so long don't count")
    for x in (one, rep, cmp_):
        x.add_argument("--config")
        x.add_argument("--similarity-threshold", type=float)
        x.add_argument("--confidence-threshold", type=float)
        x.add_argument("--restatement-threshold", type=float)
        x.add_argument("--prompt-similarity-threshold", type=float)
        x.add_argument("--intent-strategy", choices=sorted(STRATEGIES), default="whole")
        x.add_argument("--phase-weights")
        x.add_argument("--cost-model")
        x.add_argument("--no-input-analysis", action="store_true")
    for x in (one, cmp_, ls):
        x.add_argument("--format")
    return p


def configured(args: argparse.Namespace) -> Config:
    """The configuration file's values, over them the command line's; plug-ins are loaded, those of installed packages and those that the file names."""
    config = Config.load(args.config)
    REGISTRY.discover()
    REGISTRY.load({k.rstrip("s"): [v] if isinstance(v, str) else v for k, v in config.plugins.items()})
    if isinstance(config.model, str):
        config = config.merge(model=parse_cost_model(config.model))
    return config.merge(
        similarity=args.similarity_threshold, confidence=args.confidence_threshold, restatement=args.restatement_threshold, prompt_similarity=args.prompt_similarity_threshold, format=getattr(args, "format", None),
        weights=parse_weights(args.phase_weights) if args.phase_weights else None, model=parse_cost_model(args.cost_model) if args.cost_model else None,
    )


def _print(pieces: Iterable[str]) -> None:
    for x in pieces:
        print(x)


def _watch(spark: SparkSession, args: argparse.Namespace) -> None:
    from spanforge.streaming import live

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    interval = None if args.once else args.interval
    if args.dashboard:
        show = lambda t: print(f"{t['sessions']} sessions  mean TER {t['mean_ter']:.2f}  {t['total_tokens']:,} tokens  {t['waste_tokens']:,} waste", flush=True)
        live.watch_dashboard(spark, args.path, args.checkpoint, show, interval, idle_ms=int(args.idle_minutes * 60_000) if args.idle_minutes else None).awaitTermination()
        return
    tell = lambda s: print(f"{s['session_id']}  #{s['msg_seq']}  TER {s['ter']:.2f}  {s['direction']}  {s['warning']}", flush=True)
    live.watch(spark, args.path, args.checkpoint, tell, interval).awaitTermination()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("spanforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.command == "list":
            rows = [r.asDict() for r in transcripts.sessions(spark, args.path, args.limit).collect()]
            print(json.dumps(rows, indent=2, default=str) if args.format == "json" else "\n".join(f"{r['modified']}  {r['size']:>10,}  {r['name']}  agents {r['subagents']}" for r in rows))
            return 0
        if args.command == "watch":
            _watch(spark, args)
            return 0
        if args.command == "validate":
            files, lines = analyze.faults_at(spark, args.path)
            found = files.orderBy("session_id").collect()
            for r in found:
                print(f"{r.session_id}: {r.valid_lines} of {r.lines} lines valid, {r.errors} errors, {r.warnings} warnings")
            for r in lines.orderBy("session_id", "line_no").toLocalIterator():
                print(f"  {r.session_id}:{r.line_no}: {'; '.join([*r.errors, *r.warnings])}")
            return int(any(r.errors for r in found))
        config = configured(args)
        if args.command == "compare":
            a = analyze.transcripts_at(spark, args.paths, config, strategy=args.intent_strategy).persist()
            results = report.compared(a, args.sort, config)
            if args.baseline:
                two = results.take(3)
                if len(two) != 2:
                    raise ValueError("--baseline takes two sessions")
                print(report.baseline_markdown(*map(report.as_dict, sorted(two, key=lambda r: r.session_id))))
            else:
                _print(report.printed(a, results, config.format, True, sys.stdout.isatty()))
            return 0
        if args.command == "analyze" and args.quick:
            for r in analyze.quick_at(spark, args.path, config).orderBy("session_id").toLocalIterator():
                print(json.dumps(r.asDict()))
            return 0
        a = analyze.transcripts_at(spark, args.path, config, strategy=args.intent_strategy).persist()
        if args.command == "analyze" and args.group:
            _print(report.json_lines(report.groups(a, config)) if config.format == "json" else report.grouped_lines(a, config, sys.stdout.isatty()))
            return 0
        if args.command == "analyze" and args.output:
            report.write(a, args.output, config.format, config, not args.no_input_analysis)
            return 0
        results = report.told(a, config, not args.no_input_analysis).orderBy("session_id")
        if args.command == "report":
            text = report.as_markdown(report.as_dict(results.take(1)[0]))
            if args.output:
                with open(args.output, "w") as f:
                    f.write(text)
            else:
                print(text)
        else:
            _print(report.printed(a, results, config.format, False, sys.stdout.isatty()))
        return 0
    except (ValueError, TypeError, KeyError, AttributeError, IndexError, FileNotFoundError, ImportError, PySparkException) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
