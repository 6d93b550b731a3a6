"""Command line: query, batch, scan, analyze, compact, check, trace, raw-count.

    python -m rangelake.cli query -i DIR -e 0 -x 10 -y 12 [-r RANK] [--candidates]
    python -m rangelake.cli batch -i DIR -b queries.csv
    python -m rangelake.cli analyze -i DIR [-q OUT]
    python -m rangelake.cli compact -i DIR -o OUT [-e EPOCH]

DIR holds block files, or records as Parquet (with --parquet).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analytics as A
from .operators import layout as L
from .operators import manifest as M
from .operators import query as Q
from .operators import validate as C
from .operators.timing import Timer, log_query
from .plans import planner as PL
from .sources import blockfile, dumps, sinks, text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rangelake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *, epoch: bool | None = None, keys: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help_)
        c.add_argument("-i", "--input", required=True)
        c.add_argument("--parquet", action="store_true", help="the input is Parquet")
        if epoch is not None:
            c.add_argument("-e", "--epoch", type=int, required=epoch)
        if keys:
            c.add_argument("-x", "--low", type=float, required=True)
            c.add_argument("-y", "--high", type=float, required=True)
        return c

    q = command("query", "records of an epoch with keys in a range", epoch=True, keys=True)
    q.add_argument("-r", "--rank", type=int)
    q.add_argument("-c", "--closed", default="both")
    q.add_argument("--candidates", action="store_true")
    q.add_argument("--log", help="folder of the query log")
    command("scan", "the same by a full scan", epoch=True, keys=True)
    b = command("batch", "all queries of a file, in one job")
    b.add_argument("-b", "--batch", required=True)
    a = command("analyze", "summary and overlap curves of the manifest")
    a.add_argument("-q", "--plan", help="write a query plan there")
    a.add_argument("-o", "--curves", help="write overlap curves there")
    c = command("compact", "epochs in key order", epoch=False)
    c.add_argument("-o", "--output", help="default: the input's name with .merged")
    command("check", "records outside their block's range")
    t = command("trace", "particle dumps to their energies", epoch=None)
    t.add_argument("-o", "--output", required=True)
    t.add_argument("-s", "--first", type=int, default=0)
    t.add_argument("-t", "--last", type=int, default=2**31 - 1)
    command("raw-count", "hits in files of 32-bit floats", keys=True)
    return p


def _records(spark: SparkSession, args, values: bool = False) -> DataFrame:
    if args.parquet:
        return spark.read.parquet(args.input)
    return spark.read.format("rdb" if values else "rdb_keys").load(args.input)


def _manifest(spark: SparkSession, args) -> DataFrame:
    return M.build_manifest(spark.read.parquet(args.input)) if args.parquet else spark.read.format("rdb_manifest").load(args.input)


def run(spark: SparkSession, argv: list[str]) -> int:
    args = parser().parse_args(argv)
    blockfile.register(spark)
    timer = Timer()
    with timer.event(args.command):
        if args.command == "query":
            r, m = _records(spark, args), _manifest(spark, args)
            if args.candidates:
                Q.candidates(r, m, args.epoch, args.low, args.high, args.rank).show()
            keys = Q.range_query(r, args.epoch, args.low, args.high, args.rank, args.closed)
            Q.preview(keys).orderBy("percent").show()
            s = Q.selectivity(r, m, args.epoch, args.low, args.high, args.rank)
            s.show()
            if args.log:
                got = s.first()
                log_query(spark, args.log, (args.input, args.epoch, args.low, args.high, float(got["sst_selectivity"]), float(got["key_selectivity"]), 0, 0))
        elif args.command == "scan":
            Q.preview(Q.full_scan(_records(spark, args), args.epoch, args.low, args.high)).orderBy("percent").show()
        elif args.command == "batch":
            Q.batch_report(_records(spark, args), _manifest(spark, args), text.query_batch(spark, args.batch)).orderBy("qid").show(1000)
        elif args.command == "analyze":
            m = _manifest(spark, args)
            M.epoch_stats(m).orderBy("epoch").show(1000)
            A.summarize(m).orderBy("epoch", "point").show(1000)
            curve = A.overlap_curve(m)
            A.max_overlap(curve).orderBy("Epoch").show(1000)
            if args.curves:
                sinks.write_overlap_curve(curve, args.curves)
            if args.plan:
                sinks.write_query_plan(PL.query_plan(m), args.plan)
        elif args.command == "compact":
            L.compact(_records(spark, args, values=True), args.output or args.input.rstrip("/") + ".merged", None if args.epoch is None else [args.epoch])
        elif args.command == "check":
            bad = C.report(_records(spark, args), _manifest(spark, args))
            bad.show()
            if bad.take(1):
                return 1
        elif args.command == "trace":
            sinks.write_trace(dumps.energies(dumps.particles(spark, args.input)).where(F.col("t").between(args.first, args.last)), args.output)
        else:
            per = Q.raw_count(dumps.raw_trace(spark, args.input), args.low, args.high)
            Q.raw_summary(per).show()
            Q.top_hits(per).show()
    timer.table(spark).show()
    return 0


def main() -> None:
    sys.exit(run(SparkSession.builder.appName("rangelake").getOrCreate(), sys.argv[1:]))


if __name__ == "__main__":
    main()
