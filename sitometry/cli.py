"""``python -m sitometry.cli STAGE --flag ...``: one stage on a session that is there or made for it."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from . import config
from .plans import stages


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    stage = config.parsed(argv)
    session = spark or SparkSession.builder.appName("sitometry").getOrCreate()
    for name, df in stages.run(session, stage).items():
        print(f"{name}: {df.count()} rows in {stage.out}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
