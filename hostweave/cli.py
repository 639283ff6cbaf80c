"""Command line: ``run`` (the default) scans for the configured targets; ``index status|build|drop``; ``query``."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from hostweave.operators.graph import Metric, Options
from hostweave.plans import report, scan, setup
from hostweave.plans.config import Config, locate
from hostweave.plans.progress import Progress, Update
from hostweave.plans.tiers import Store, parse_tiers


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-c", "--config", default=argparse.SUPPRESS)
    loud = common.add_mutually_exclusive_group()
    loud.add_argument("-v", "--verbose", action="count", default=argparse.SUPPRESS)
    loud.add_argument("-q", "--quiet", action="store_true", default=argparse.SUPPRESS)
    top = argparse.ArgumentParser(prog="hostweave", parents=[common], description="Inbound and outbound links of domains in a web graph")
    commands = top.add_subparsers(dest="command")
    commands.add_parser("run", parents=[common], help="scan all files for the configured targets")
    index = commands.add_parser("index", parents=[common], help="state, building and dropping of tiers").add_subparsers(dest="action", required=True)
    index.add_parser("status", parents=[common])
    for action in ("build", "drop"):
        index.add_parser(action, parents=[common]).add_argument("tiers", nargs="*", default=[])
    query = commands.add_parser("query", parents=[common], help="one domain, from the tiers")
    query.add_argument("domain")
    query.add_argument("--top", type=int, default=25)
    query.add_argument("--metric", type=Metric.parse)
    query.add_argument("--json", action="store_true")
    query.add_argument("--save", action="store_true")
    return top


def _duration(s: float) -> str:
    return f"{s:.0f} s" if s < 60 else f"{s // 60:.0f} min" if s < 3600 else f"{s // 3600:.0f} h {s % 3600 // 60:.0f} min"


def _show(u: Update) -> None:
    rest = f", about {_duration(u.eta_s)} left" if u.eta_s is not None else ""
    print(f"\r{u.overall:6.1%} {u.label}{rest}    ", end="", file=sys.stderr, flush=True)


def status_text(store: Store) -> str:
    s = store.status()
    out = [f"index: {s.root}", f"domains: {s.node_count}   links: {s.edge_count}   size: {setup.human(s.total_bytes)}   free: {setup.human(s.free_bytes)}"]
    for t in s.tiers:
        size = setup.human(t.bytes) if t.state != "missing" else f"about {setup.human(t.estimated_bytes)}, {setup.human(t.estimated_temp_bytes)} while building"
        out.append(f"  {t.key:<8} {t.state:<8} {size}" + (f"   built {t.built_at}" if t.built_at else ""))
    out += [f"  {x['kind']:<8} {setup.human(x['size_bytes']) if x['exists'] else 'missing'}   {x['path']}" for x in s.sources]
    if s.blockers:
        out += ["", *(f"! {b}" for b in s.blockers), "", setup.instructions(s.crawl, os.path.dirname(s.sources[0]["path"]))]
    return "\n".join(out)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    quiet = getattr(args, "quiet", False)
    logging.basicConfig(level=logging.ERROR if quiet else [logging.WARNING, logging.INFO, logging.DEBUG][min(2, getattr(args, "verbose", 0))])
    config = Config.load(locate(getattr(args, "config", None)))
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("hostweave").getOrCreate()
    progress = Progress(None if quiet else _show, spark)
    store = Store(spark, config.index_dir, config.sources)
    if args.command in (None, "run"):
        config.ensure_files()
        print("\n".join(scan.run(spark, config.sources, config.targets, config.results_dir, config.metric, progress)))
    elif args.command == "index":
        if args.action == "build":
            store.build(parse_tiers(args.tiers), progress)
        elif args.action == "drop":
            if not args.tiers:
                raise SystemExit("name the tiers to drop, or all")
            store.drop(parse_tiers(args.tiers))
        print(status_text(store))
    else:
        found = store.engine().query(args.domain, Options(metric=args.metric or config.metric))
        print(json.dumps(report.to_json(found), indent=2, ensure_ascii=False) if args.json else report.as_text(found, args.top))
        if args.save:
            print(f"saved: {report.save(found, config.results_dir)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
