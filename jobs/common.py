"""What the jobs share: their config, their log, the command line."""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from sparkloom.session import ensure_importable, shared_dir

log = logging.getLogger("jobs")


def default_config(name: str) -> dict:
    """The config that lies beside a job's code."""
    return json.loads(Path(__file__).with_name(f"{name}.json").read_text())


def read_config(spark: SparkSession, name: str, path: str | None) -> dict:
    """A job's settings: its own file's, and over them those of the file at `path`, which Spark reads."""
    config = default_config(name)
    if path:
        given = json.loads(spark.read.text(path, wholetext=True).first()["value"])
        if unknown := given.keys() - config.keys():
            raise ValueError(f"{path} has settings that {name} does not know: {', '.join(sorted(unknown))}")
        config |= given
    return config


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the folder that the cluster shares, which no other call uses."""
    return f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"


def main(name: str, run: Callable, *paths: str) -> None:
    """The command line of a job: its paths and --config. Only here a session is made and stopped."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", help="a JSON file with settings in place of the default ones")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = ensure_importable(SparkSession.builder.appName(name).getOrCreate())
    try:
        run(spark, **{p: given[p] for p in paths}, config=read_config(spark, name, given["config"]))
    finally:
        spark.stop()
