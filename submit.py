"""Entry points for spark-submit.

    spark-submit submit.py train INPUT OUTPUT [--config FILE]
    spark-submit submit.py score INPUT RUN OUTPUT
    spark-submit submit.py augment INPUT OUTPUT [--rows N] [--seed N]

INPUT is a transaction log as CSV with a header (or parquet, with --format parquet).  The shared folder is the
session's spark.checkpoint.dir.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.operators.augment import augment  # noqa: E402
from ledgerlens.plans.training import load_run, training_run  # noqa: E402
from ledgerlens.session import stage, staging  # noqa: E402
from ledgerlens.sources.config import RunConfig, load_config  # noqa: E402
from ledgerlens.sources.readers import read_in_file_order, read_transactions, with_key  # noqa: E402
from ledgerlens.sources.writers import write_augmented  # noqa: E402


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = top.add_subparsers(dest="job", required=True)
    for name, places in (("train", ("output",)), ("score", ("run", "output")), ("augment", ("output",))):
        job = jobs.add_parser(name)
        for place in ("input", *places):
            job.add_argument(place)
        job.add_argument("--format", choices=("csv", "parquet"), default="csv")
    jobs.choices["train"].add_argument("--config")
    jobs.choices["augment"].add_argument("--rows", type=int, default=43_000)
    jobs.choices["augment"].add_argument("--seed", type=int, default=42)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName(f"ledgerlens-{args.job}").getOrCreate()
    config = load_config(args.config) if args.job == "train" and args.config else RunConfig()
    # Rows to be skipped are counted in the order of the log.
    read = read_in_file_order if args.job == "train" and config.data.start_row else read_transactions
    rows = read(spark, args.input) if args.format == "csv" else with_key(spark.read.parquet(args.input))
    with staging(spark):
        # Many passes follow; the scan and its key are made once.
        rows = stage(rows, "log")
        if args.job == "train":
            training_run(rows, config).save(args.output)
        elif args.job == "score":
            load_run(spark, args.run).score(rows).write.mode("overwrite").parquet(args.output)
        else:
            write_augmented(augment(rows, args.rows, args.seed), args.output)


if __name__ == "__main__":
    main()
