"""python -m ledgerloom.cli: match a ledger export with a settlement file and report the exceptions."""

from __future__ import annotations

import argparse
import hashlib
import sys

from pyspark.sql import DataFrame

from ledgerloom.operators import reconcile
from ledgerloom.session import session
from ledgerloom.sources import adapters, sinks


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="ledgerloom", description=__doc__)
    p.add_argument("--internal", required=True, help="ledger export, JSON lines")
    p.add_argument("--external", required=True, help="settlement file")
    p.add_argument("--external-format", default="nibss", help=f"one of {', '.join(sorted(adapters.FORMATS))}")
    p.add_argument("--tolerance-window", type=float, default=120.0, help="largest difference of the times of a match, in seconds; 0 for any")
    p.add_argument("--format", default="text", choices=sorted(sinks.REPORTS), help="of the report")
    p.add_argument("--report", help="folder that executors write the report to (as JSON: its exceptions), instead of standard output")
    p.add_argument("--runs", help="folder of runs and their exceptions; without it nothing is kept")
    p.add_argument("--feedback", help="folder that requests for pending reversals are appended to")
    return p.parse_args(argv)


def run(args: argparse.Namespace, out=sys.stdout, err=sys.stderr) -> DataFrame:
    spark = session()
    internal = adapters.read_ledger_json(spark, args.internal)
    external = adapters.read_external(spark, args.external, args.external_format)
    # The report, the feedback and the run are three readers of one match.
    classified = reconcile.classify(internal, external, args.tolerance_window).persist()
    try:
        if args.report:
            write = sinks.write_text_report if args.format == "text" else lambda rows, path, *_: sinks.write_exceptions_json(rows, path)
            write(classified, args.report, args.internal, args.external)
        else:
            out.write(sinks.render(classified, args.internal, args.external, args.format))
        print_ = adapters.fingerprint(spark, args.internal, args.external) if args.feedback or args.runs else ""
        if args.feedback:  # before the run is kept, so a failure here does not hide behind a finished run
            n = sinks.append_requests(reconcile.corrective_requests(classified), args.feedback, print_)
            err.write(f"feedback: {n} requests\n")
        if args.runs:
            params = hashlib.sha256(f"{args.tolerance_window}|{args.external_format}".encode()).hexdigest()
            run_id, written = sinks.persist(classified, args.runs, args.internal, args.external, print_, params)
            err.write(f"run {run_id}: {'kept' if written else 'this input has a run already, nothing written'}\n")
    finally:
        classified.unpersist()
    return classified


if __name__ == "__main__":
    run(arguments())
