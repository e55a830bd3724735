"""Commands: run, demo, check. Exit code 2 on errors that the user can act on."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import report
from .errors import TidemarkError
from .plans import pipeline, spec
from .sources import readers, synthetic


def session(name: str = "tidemark") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def lacking(own: spec.Spec, entity: list[str], logs: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(group, column) of configured feature columns that their source lacks."""
    out = []
    for g in own.groups:
        if g.temporal != "derived":
            have = set(entity if g.source == "entity" else logs[g.source])
            out += [(g.name, c.name) for c in g.columns if c.name not in have and c.name not in ("tenure_days", "recency_days")]
    return out


def missing_columns(spark: SparkSession, own: spec.Spec) -> list[tuple[str, str]]:
    data = readers.dataset(spark, own, check=False)
    return lacking(own, data.entity.columns, {n: d.columns for n, d in data.events.items()})


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("command", choices=("run", "demo", "check"), nargs="?", default="run")
    parser.add_argument("--config", default="config", help="folder of the YAML files")
    parser.add_argument("--output", help="folder of the report")
    parser.add_argument("--customers", type=int, default=3000, help="size of the demonstration")
    own = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(message)s")
    spark = session()
    try:
        if own.command == "demo":
            synthetic.write(synthetic.make(spark, own.customers), str(Path(own.config).parent / "data"))
            return 0
        plan = spec.load(own.config)
        if own.command == "check":
            gaps = missing_columns(spark, plan)
            for group, column in gaps:
                print(f"{group}: {column} is not in its source")
            return 2 if gaps else 0
        done = pipeline.run(spark, plan)
        folder = own.output or str(Path(own.config).parent / plan.options["run"]["output_dir"])
        print("\n".join(report.write(done, folder)))
        return 0
    except TidemarkError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
