"""What both jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("wattloom.jobs")


def main(description: str, default: str, run: Callable[[SparkSession, dict], object], paths: list[str]) -> None:
    """Reads the configuration, lets arguments replace its paths, and runs the job in a session of its own."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", default=default, help="JSON file (default: %(default)s)")
    for p in paths:
        parser.add_argument(f"--{p}", help=f"replaces {p!r} of the configuration")
    args = vars(parser.parse_args())
    with open(args.pop("config")) as f:
        config = json.load(f)
    config |= {k: v for k, v in args.items() if v}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(description).getOrCreate()
    try:
        run(spark, config)
    finally:
        spark.stop()
