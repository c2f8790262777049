"""python -m idsets COMMAND ...: build, info, has, intersect, id and terms."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def session() -> SparkSession:
    spark = SparkSession.builder.appName("idsets").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str] | None = None) -> int:
    from idsets.functions.hashing import positional_id
    from idsets.functions.unsigned import shown
    from idsets.operators.dictionary import Keyer
    from idsets.operators.idset import signed
    from idsets.sources import setfile, text

    parser = argparse.ArgumentParser(prog="idsets", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="a set file from a text file of ids")
    build.add_argument("source")
    build.add_argument("target")
    info = commands.add_parser("info", help="members, bytes and ends of a set file")
    info.add_argument("file")
    has = commands.add_parser("has", help="whether ids are in a set file")
    has.add_argument("file")
    has.add_argument("ids", nargs="+", type=int)
    both = commands.add_parser("intersect", help="the ids in all of two set files or more")
    both.add_argument("files", nargs="+")
    both.add_argument("--list", action="store_true")
    both.add_argument("--bench", type=int, default=0)
    ids = commands.add_parser("id", help="positional ids of terms")
    ids.add_argument("terms", nargs="+")
    terms = commands.add_parser("terms", help="dense ids of a term file's terms")
    terms.add_argument("file")
    terms.add_argument("wanted", nargs="*")
    args = parser.parse_args(argv)
    spark = session()
    if args.command == "build":
        start = time.time()
        raw = text.parse_ids(spark.read.text(args.source))
        found = text.IdSet.from_column(raw)
        setfile.write_set(found, args.target)
        print(f"{raw.count()} ids read, {setfile.read_set(spark, args.target).count()} different, {time.time() - start:.2f} s")
    elif args.command == "info":
        r = setfile.read_set(spark, args.file).info().first()
        print(f"members {r.members}, bytes {r.bytes}" + (f", from {r.min_id & (1 << 64) - 1} to {r.max_id & (1 << 64) - 1}" if r.members else ""))
    elif args.command == "has":
        own = setfile.read_set(spark, args.file)
        probes = spark.createDataFrame([(k, signed(i)) for k, i in enumerate(args.ids)], "ordinal int, id bigint")
        for r in own.members(probes).orderBy("ordinal").collect():
            print(f"{r.id & (1 << 64) - 1} {'yes' if r.member else 'no'}")
    elif args.command == "intersect":
        if len(args.files) < 2:
            parser.error("two files or more are needed")
        first, *rest = (setfile.read_set(spark, f) for f in args.files)
        result = first.intersect(*rest)
        print(f"{result.count()} ids in all of {len(args.files)} sets")
        if args.list:
            print(*result.ids(), sep="\n")
        times = []
        for _ in range(args.bench):
            start = time.time()
            result.count()
            times.append(time.time() - start)
        if times:
            print(f"best of {len(times)}: {min(times):.3f} s")
    elif args.command == "id":
        rows = spark.createDataFrame([(k, t) for k, t in enumerate(args.terms)], "ordinal int, term string")
        for r in rows.select("ordinal", "term", shown(positional_id(F.col("term"))).alias("id")).orderBy("ordinal").collect():
            print(f"{r.term} {r.id}")
    else:
        source = text.read_terms(spark, args.file)
        keyer = Keyer.build(source)
        print(f"{len(keyer)} terms")
        wanted = [(k, t) for k, t in enumerate(args.wanted)] or [(r.ordinal, r.term) for r in source.orderBy("ordinal").limit(5).collect()]
        for r in keyer.lookup(spark.createDataFrame(wanted, "ordinal bigint, term string")).orderBy("ordinal").collect():
            print(f"{r.term} {'absent' if r.id is None else r.id}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
