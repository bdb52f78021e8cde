"""``python -m pixelspark``: converts image files, and prints tables, transforms and byte forms."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .functions import integer
from .operators.codecs import leb128
from .plans import catalog
from .session import local_session, send_package
from .sources import images


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pixelspark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    convert = commands.add_parser("convert", help="files below a path to another format, as a table")
    convert.add_argument("source")
    convert.add_argument("target")
    convert.add_argument("--format", required=True, choices=sorted(images.ENCODERS))
    tables = commands.add_parser("tables", help="print a table of code points or layouts")
    tables.add_argument("name", choices=sorted(catalog.QUERIES))
    wht = commands.add_parser("wht", help="the 4 x 4 Walsh-Hadamard transform of 16 integers, and back")
    wht.add_argument("values", nargs=16, type=int)
    number = commands.add_parser("leb128", help="the bytes of an unsigned integer")
    number.add_argument("value", type=int)
    args = parser.parse_args(argv)
    if args.command == "leb128":
        print(leb128(args.value).hex(" "))
        return 0
    spark = local_session(cores=4, memory="4g")
    send_package(spark)
    if args.command == "tables":
        catalog.QUERIES[args.name][0](spark, "").show(100, truncate=False)
    elif args.command == "wht":
        block = F.array(*[F.lit(v) for v in args.values])
        row = spark.range(1).select(integer.fwht4x4(block).alias("t"), integer.iwht4x4(integer.fwht4x4(block)).alias("back")).first()
        print(row.t, "round trip holds" if row.back == args.values else "round trip FAILS")
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(args.source)
        images.convert(files, args.format).write.mode("errorifexists").parquet(args.target)
        spark.read.parquet(args.target).select("path", "format", F.round("ratio", 3).alias("ratio")).show(100, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
