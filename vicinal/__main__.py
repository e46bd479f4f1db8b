"""Command line: a matrix file to a layout, and its metrics.

python -m vicinal --input x.fvecs --n 1000 --dim-in 64 --out layout --k 15 --perplexity 10
"""

from __future__ import annotations

import argparse
import json
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vicinal.operators.layout import Config, embed
from vicinal.plans.sweep import metrics
from vicinal.sources.vectors import read_vectors, write_layout


def parse(argv: list[str] | None = None) -> tuple[argparse.Namespace, Config]:
    p = argparse.ArgumentParser(prog="vicinal", description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--n", type=int, required=True)
    p.add_argument("--dim-in", type=int, required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--stride", type=int)
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--metrics", action="store_true", help="print a JSON object of scores")
    for f in fields(Config):
        p.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
    args = p.parse_args(argv)
    return args, Config(**{f.name: getattr(args, f.name) for f in fields(Config)})


def main(argv: list[str] | None = None) -> None:
    args, config = parse(argv)
    spark = SparkSession.builder.appName("vicinal").getOrCreate()
    options = {} if args.input.endswith((".fvecs", ".parquet")) else {"stride": args.stride, "offset": args.offset}
    points = read_vectors(spark, args.input, args.n, args.dim_in, **options).select("id", F.col("features").cast("array<double>").alias("v"))
    found = embed(spark, points, config)
    print(*write_layout(found, args.out), sep="\n")
    if args.metrics:
        print(json.dumps(metrics(points, found, config.dim).first().asDict()))


if __name__ == "__main__":
    main()
