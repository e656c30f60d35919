"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether a query's shuffle files are removed as soon as it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset and all runs on one machine (tests) a temporary folder
    is made; on a cluster the setting is required.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="sitometry-")
        sc.setCheckpointDir(where)
        where = sc.getCheckpointDir()
    return where


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage there.

    The shuffle files of the write go with its end, not only when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    if files := df.inputFiles():
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a narrow table."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of the table of ``marks``: so many a key, a power of two within these; and the parts in which it is made.
KEY_BITS, LEAST_BITS, MOST_BITS, BIT_PARTS = 16, 1 << 16, 1 << 28, 16


def marks(keys: DataFrame, column: str | Column) -> tuple[Column, Callable[[pa.Array], np.ndarray]]:
    """The cell of a row by its ``column``, and which of a list of cells are marked: all that ``keys`` fall in, and few others.

    A key's hash sets one bit of a table of at most ``MOST_BITS`` (32 MB), which is broadcast; some 6 % of other rows are
    marked too, more where the keys are too many for it.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (KEY_BITS * keys.count()).bit_length()))
    each = bits // BIT_PARTS
    cell = F.pmod(F.xxhash64(column), F.lit(bits))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            cells = b["cell"].to_numpy(zero_copy_only=False)
            for part in np.unique(cells // each).tolist():
                made.setdefault(part, np.zeros(each, bool))[cells[cells // each == part] % each] = True
        if made:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(made), pa.int32()), "packed": pa.array([np.packbits(x).tobytes() for x in made.values()], pa.binary())})

    parts = keys.select(cell.alias("cell")).repartition(BIT_PARTS, F.floor(F.col("cell") / each)).mapInArrow(packed, "part int, packed binary")
    found = {r["part"]: bytes(r["packed"]) for r in parts.collect()}  # at most MOST_BITS / 8 bytes
    table = keys.sparkSession.sparkContext.broadcast(b"".join(found.get(k, bytes(each // 8)) for k in range(BIT_PARTS)))

    def marked(cells: pa.Array) -> np.ndarray:
        at = cells.to_numpy(zero_copy_only=False)
        return (np.frombuffer(table.value, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

    return cell, marked


def parted(rows: DataFrame, column: str | Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``column`` is among that of ``keys``, with few others (see ``marks``), and the rest, of which none is."""
    cell, marked = marks(keys, column)

    @F.arrow_udf("boolean")
    def passed(cells: pa.Array) -> pa.Array:
        return pa.array(marked(cells))

    return rows.filter(passed(cell)), rows.filter(~passed(cell))


def among(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``column`` is among that of ``keys``, and few others (see ``marks``), for a join that follows: what it would
    drop is left out before it is shuffled. Rows go to Python without their other columns."""
    return parted(rows, column, keys)[0]


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, so that no column of its own is touched."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_sample(docs: DataFrame, label: str, rows: int) -> DataFrame:
    """``text, label`` of about ``rows`` labelled texts at most, shared out evenly among the labels.

    A hash of id and text chooses them, at a rate from the labels' counts; texts stay whole. Every
    label takes part, with one text at least, so more labels than ``rows`` give as many texts; the
    driver holds the labels, as a model of them does.
    """
    text = F.col("text").cast("string")
    good = docs.select(text.alias("text"), F.col(label).alias("label"), (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("unit"))
    good = good.filter(F.col("label").isNotNull() & F.col("text").rlike(r"\S"))
    counts = good.groupBy("label").agg(F.count(F.lit(1)).alias("count"), F.min("unit").alias("least")).collect()
    kind = dict(good.dtypes)["label"]
    if not counts:
        return good.select("text", "label")
    each = max(1, rows // len(counts))
    # the least hash of a label takes part at any rate
    rates = docs.sparkSession.createDataFrame([(r["label"], min(1.0, each / r["count"]), r["least"]) for r in counts], f"label {kind}, rate double, least double")
    return good.join(F.broadcast(rates), "label").filter("unit < rate or unit = least").select("text", "label")
