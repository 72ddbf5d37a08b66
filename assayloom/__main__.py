"""python -m assayloom --input-path DIR ...: one feature-selection run; with --runs TABLE a run a row."""

from __future__ import annotations

import argparse
import logging
import time
from dataclasses import fields

from pyspark.sql import SparkSession

from assayloom.config import Options, Settings, read_settings
from assayloom.plans.run import prepare_and_store, run, run_matrix
from assayloom.runtime import ship
from assayloom.sources.files import read_runs
from assayloom.sources.sinks import Lines, save_log


def parse(argv: list[str] | None = None) -> tuple[Options | None, str | None, str | None]:
    """The options (none where a table of runs has them), the settings' file and the table of runs."""
    parser = argparse.ArgumentParser(prog="assayloom", description=__doc__)
    parser.add_argument("--config")
    parser.add_argument("--runs")
    for f in fields(Options):
        flag = f"--{f.name.replace('_', '-')}"
        if isinstance(f.default, bool):
            parser.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            parser.add_argument(flag, default=f.default)
    given = vars(parser.parse_args(argv))
    config, runs = given.pop("config"), given.pop("runs")
    return None if runs else Options(**given), config, runs


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    options, config, runs = parse(argv)
    settings = read_settings(config) if config else Settings()
    spark = ship(SparkSession.builder.appName("assayloom").getOrCreate())
    if runs:
        logging.info("done: %s", ", ".join(run_matrix(spark, read_runs(spark, runs), settings)))
        return
    name = f"{options.model}_{int(time.time())}"
    lines = Lines()
    logging.getLogger().addHandler(lines)
    try:
        (prepare_and_store if options.prepare_data else run)(spark, options, settings, name)
        logging.info("done: %s", name)
    except Exception:
        logging.exception("failed: %s", name)
        raise
    finally:
        logging.getLogger().removeHandler(lines)
        save_log(spark, options, name, lines.lines)


if __name__ == "__main__":
    main()
