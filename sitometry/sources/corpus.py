"""A folder of XML files parsed once: a store that follows the folder's changes.

Each refresh digests the files, parses those that are new or changed and writes a manifest that says, for every file
there is, in which version its blocks lie. A changed file's blocks are replaced and a removed file's go, since the
manifest no longer names them; nothing written is changed. A version counts once its number is noted, last of
all, so a refresh that fails leaves the store as it was and can be run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import epidoc

MANIFEST = "path string, digest string, ok boolean, ddb_id string, version int"
DOCUMENTS = f"path string, digest string, ok boolean, ddb_id string, blocks {epidoc.BLOCKS}"


def version(spark: SparkSession, store: str) -> int:
    """The last complete version; 0 of a store that has none."""
    spark.createDataFrame([], "version int").write.mode("append").parquet(f"{store}/versions")
    return spark.read.schema("version int").parquet(f"{store}/versions").agg(F.max("version")).first()[0] or 0


def _manifest(spark: SparkSession, store: str, at: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifest-{at}") if at else spark.createDataFrame([], MANIFEST)


def refresh(spark: SparkSession, texts: str, store: str, commentary: bool = False) -> dict[str, int]:
    """Brings the store up to the folder's state: how many files are ``same``, ``new``, ``changed`` and ``removed``.

    Files are told by their path and compared by the digest of their content. A run without a change adds no version.
    """
    before = version(spark, store)
    files = epidoc.read_files(spark, texts).withColumn("digest", F.sha2("content", 256))
    known = _manifest(spark, store, before)
    old = known.select(F.col("path").alias("_path"), F.col("digest").alias("_digest"))
    told = files.select("path", "digest").join(old, F.col("path") == F.col("_path"), "full")
    state = F.when(F.col("_path").isNull(), "new").when(F.col("path").isNull(), "removed").when(F.col("digest") != F.col("_digest"), "changed").otherwise("same")
    counts = {r["state"]: r["count"] for r in told.groupBy(state.alias("state")).count().collect()}
    found = {s: counts.get(s, 0) for s in ("same", "new", "changed", "removed")}
    if before and found["same"] == sum(found.values()):
        return found
    at = before + 1
    fresh = files.join(old, (F.col("path") == F.col("_path")) & (F.col("digest") == F.col("_digest")), "left_anti")
    parsed = epidoc.parsed(fresh.select("path", epidoc.decoded("content").alias("xml"), "digest"), commentary, ["digest"])
    # what an earlier, failed run left under this number is written over
    parsed.select("path", "digest", "ok", "ddb_id", "blocks").write.mode("overwrite").parquet(f"{store}/documents-{at}")
    added = spark.read.schema(DOCUMENTS).parquet(f"{store}/documents-{at}").select("path", "digest", "ok", "ddb_id", F.lit(at).alias("version"))
    kept = known.join(files.select("path", "digest"), ["path", "digest"], "left_semi")
    kept.unionByName(added).write.mode("overwrite").parquet(f"{store}/manifest-{at}")
    spark.createDataFrame([(at,)], "version int").write.mode("append").parquet(f"{store}/versions")
    return found


def documents(spark: SparkSession, store: str) -> DataFrame:
    """``path, ok, ddb_id, blocks`` of every file of the folder as last refreshed; one not ``ok`` did not parse."""
    at = version(spark, store)
    manifest = _manifest(spark, store, at)
    used = [r["version"] for r in manifest.select("version").distinct().collect()]
    out = spark.createDataFrame([], DOCUMENTS).withColumn("version", F.lit(0))
    for v in sorted(used):
        out = out.unionByName(spark.read.schema(DOCUMENTS).parquet(f"{store}/documents-{v}").withColumn("version", F.lit(v)))
    return out.join(manifest.select("path", "version"), ["path", "version"], "left_semi").select("path", "ok", "ddb_id", "blocks")


def compact(spark: SparkSession, store: str) -> None:
    """All of the store's files in one new version, so that few versions are read."""
    at = version(spark, store) + 1
    manifest = _manifest(spark, store, at - 1)
    documents(spark, store).join(manifest.select("path", "digest"), "path").select("path", "digest", "ok", "ddb_id", "blocks").write.mode("overwrite").parquet(f"{store}/documents-{at}")
    manifest.withColumn("version", F.lit(at)).write.mode("overwrite").parquet(f"{store}/manifest-{at}")
    spark.createDataFrame([(at,)], "version int").write.mode("append").parquet(f"{store}/versions")
