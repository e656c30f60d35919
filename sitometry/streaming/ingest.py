"""New XML files as they arrive, each once: the checkpoint remembers what has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import harvest
from ..sources import epidoc
from ..vocab import GREEK, Profile

FILE = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, root: str) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(root)
    return files.select("path", F.decode("content", "UTF-8").alias("xml"))


def harvest_new(spark: SparkSession, root: str, out: str, checkpoint: str, profile: Profile = GREEK) -> StreamingQuery:
    """Writes the candidates among the files that came since the last run, then stops.

    Each batch has its own folder, which a batch that is delivered again writes over.
    """

    def write(batch: DataFrame, number: int) -> None:
        blocks = epidoc.blocks_of(epidoc.parsed(batch))
        harvest.candidates(blocks, profile).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return new_files(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """Of candidates with one id those of the last batch: a file that was changed came again."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("ddb_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["ddb_id", "batch"], "left_semi").drop("batch")
