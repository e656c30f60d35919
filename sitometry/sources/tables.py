"""Tables of text: CSV with byte order mark, spreadsheets, appending and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """All columns as text; a byte order mark is dropped, quoted fields may span lines.

    Raises ValueError without a required column; rows in which one is blank are left out.
    """
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for c in required:
        df = df.filter(F.coalesce(F.trim(F.col(c)), F.lit("")) != "")
    return df


def write_csv(df: DataFrame, path: str, parts: int | None = None) -> None:
    """Lists are joined by ``;``. The first header of each part carries the byte order mark."""
    lists = {f.name for f in df.schema if f.dataType.typeName() == "array"}
    out = df.select(*[F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if c in lists else F.col(c) for c in df.columns])
    out = out.withColumnRenamed(out.columns[0], "﻿" + out.columns[0])
    (out.coalesce(parts) if parts else out).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True)


def read_sheets(spark: SparkSession, path: str, sheets: list[str], names: dict[str, str]) -> DataFrame:
    """Sheets of one small workbook, columns renamed, one below another; needs a spreadsheet reader."""
    import pandas as pd

    found = [pd.read_excel(path, sheet_name=s, dtype=str).rename(columns=names) for s in sheets]
    return spark.createDataFrame(pd.concat(found, ignore_index=True).astype(object).where(lambda x: x.notna(), None))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)
