"""Command line: ``validate``, ``describe``, ``check`` and ``score``.

Exit codes: 0 fine, 1 an error or, for ``check``, a norm that does not fit the log, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import json
import sys

from normslice import __version__
from normslice.errors import NormsliceError
from normslice.plans.norm import MODES, Norm
from normslice.sources.eventlog import ACTIVITY, CASE, TIMESTAMP, EventLog


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="normslice", description="Score event logs against a norm")
    parser.add_argument("--version", action="version", version=f"normslice {__version__}")
    commands = parser.add_subparsers(dest="command", required=True)
    on_norm = {"validate": "is the document a valid norm", "describe": "its constraints and weights", "check": "does it fit a log", "score": "rank the slices of a log"}
    for name, what in on_norm.items():
        p = commands.add_parser(name, help=what)
        p.add_argument("norm", help="norm document (JSON)")
        if name in ("check", "score"):
            p.add_argument("log", help="event log (CSV or Parquet)")
            for role, usual in (("case", CASE), ("activity", ACTIVITY), ("timestamp", TIMESTAMP)):
                p.add_argument(f"--{role}", default=usual, help=f"its {role} column (default {usual})")
            p.add_argument("--attr", action="append", default=[], help="a case attribute; may be repeated")
            p.add_argument("--exposure", help="exposure column")
            p.add_argument("--encoding", help="encoding of a CSV log")
            p.add_argument("--missing-timestamps", default="raise", choices=["raise", "drop", "keep"])
        if name == "score":
            p.add_argument("--by", action="append", required=True, help="a slice key; may be repeated")
            p.add_argument("--view", help="default: the norm's first view")
            p.add_argument("--gamma", type=float, default=0.0, help="shrinkage")
            p.add_argument("--volume", default="cases", help="cases, exposure or a column")
            p.add_argument("--min-cases", type=int, default=1)
            p.add_argument("--mode", choices=MODES)
            p.add_argument("--out", default="-", help="one CSV file; - is the standard output")
            p.add_argument("--cases-out", help="a folder of CSV files with a row for each case")
    return parser


def _log(args: argparse.Namespace) -> EventLog:
    from pyspark.sql import SparkSession

    from normslice.sources import formats

    options = {"encoding": args.encoding} if args.encoding else {}
    roles = {"case_col": args.case, "activity_col": args.activity, "timestamp_col": args.timestamp, "case_attributes": args.attr, "exposure_col": args.exposure}
    return formats.read_log(SparkSession.builder.getOrCreate(), args.log, read_options=options, missing_timestamps=args.missing_timestamps, **roles)


def _describe(norm: Norm) -> None:
    print(norm)
    for row in norm.describe():
        print(json.dumps(row, ensure_ascii=False))
    print("weights: constraint, layer, view, weight")
    for row in norm.weight_table():
        print(*row, sep=",")


def _check(norm: Norm, log: EventLog) -> int:
    issues = norm.check(log)
    for name, value in log.quality_report().first().asDict().items():
        print(f"{name}: {value}")
    print("\n".join(["issues:", *(f"- {x}" for x in issues)]) if issues else "no issues found")
    return 1 if issues else 0


def _score(norm: Norm, log: EventLog, args: argparse.Namespace) -> int:
    from normslice.operators.backlog import prioritize
    from normslice.operators.scoring import score
    from normslice.sources import formats

    result = score(log, norm, views=[args.view] if args.view else None, mode=args.mode)
    backlog = prioritize(result, args.by, view=args.view, gamma=args.gamma, volume="count" if args.volume == "cases" else args.volume, min_cases=args.min_cases)
    rows = backlog.toPandas()  # one row a slice
    if args.out == "-":
        rows.to_csv(sys.stdout, index=False)
    else:
        rows.to_csv(args.out, index=False)
        print(f"{len(rows)} slices in {args.out}", file=sys.stderr)
    if args.cases_out:
        formats.write_cases(result, args.cases_out, "csv")
        print(f"cases in {args.cases_out}", file=sys.stderr)
    return 0


def _run(args: argparse.Namespace) -> int:
    norm = Norm.load(args.norm)
    if args.command == "validate":
        print(f"OK: {norm}, fingerprint {norm.fingerprint}")
    elif args.command == "describe":
        _describe(norm)
    elif args.command == "check":
        return _check(norm, _log(args))
    else:
        return _score(norm, _log(args), args)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        return _run(args)
    except (NormsliceError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
