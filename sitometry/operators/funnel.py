"""Counts of a flow's stages, taken while its rows pass: no stage is read again to be counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Funnel:
    """Watches the stages of one flow. The counts are there once an action has run over the last stage.

    A stage must be part of one action only, else ``table`` tells the counts of the first one. Distinct values cannot be
    counted in passing: watch the stage that has one row for each.
    """

    def __init__(self) -> None:
        self._stages: dict[str, Observation] = {}

    def watched(self, df: DataFrame, stage: str, **tests: Column) -> DataFrame:
        """``df`` itself; counts its rows and, by name, those of which a test is true."""
        seen = self._stages[stage] = Observation()
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(t, F.lit(False))).alias(name) for name, t in tests.items()])

    def counts(self) -> dict[str, dict[str, int]]:
        return {stage: dict(seen.get) for stage, seen in self._stages.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """``step, stage, measure, n, share``: each count with its share of the stage's rows, and a stage's
        rows with their share of the first stage's (NULL of none)."""
        rows, first = [], None
        for step, (stage, found) in enumerate(self.counts().items()):
            first = found["rows"] if first is None else first
            for measure, n in found.items():
                whole = first if measure == "rows" else found["rows"]
                rows.append((step, stage, measure, n, n / whole if whole else None))
        return spark.createDataFrame(rows, "step int, stage string, measure string, n long, share double")
