"""Unpack archives as they arrive, a bounded number at a time, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assetloom.operators.files import resolve
from assetloom.sources.transfer import BATCH, archive_members

MEMBERS = "path string, name string, content binary"
DONE = "path string, members long, batch string"


def _folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of tables, empty if there is none yet."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path) if there else spark.createDataFrame([], schema)


def unpacked(spark: SparkSession, target: str) -> DataFrame:
    """(path, members, batch) of the archives that are done: those that the manifest names."""
    return _folder(spark, f"{target}/done", DONE)


def members(spark: SparkSession, target: str) -> DataFrame:
    """(path, name, content) of what was unpacked: only batches that the manifest names, so what a lost run left behind isn't read."""
    batches = [r["batch"] for r in unpacked(spark, target).select("batch").distinct().collect()]
    return spark.read.schema(MEMBERS).parquet(*[f"{target}/members/{b}" for b in sorted(batches)]) if batches else spark.createDataFrame([], MEMBERS)


def append_batch(rows: DataFrame, target: str, batch: str, suffix: str = ".jpg") -> None:
    """Unpack archives (path, content) that the manifest doesn't name, then name them.

    The members of a batch are written to its own folder, its manifest afterwards. Whoever is lost between the two
    runs the batch again and overwrites its members; after the second write the manifest keeps the archives from being unpacked again.
    """
    spark = rows.sparkSession
    new = rows.dropDuplicates(["path"]).join(unpacked(spark, target).select("path"), "path", "left_anti")
    archive_members(new, suffix).write.mode("overwrite").parquet(f"{target}/members/{batch}")
    found = spark.read.schema(MEMBERS).parquet(f"{target}/members/{batch}").groupBy("path").agg(F.count("name").alias("members"))
    done = new.select("path").join(found, "path", "left").select("path", F.coalesce("members", F.lit(0).cast("long")).alias("members"), F.lit(batch).alias("batch"))
    done.write.mode("overwrite").parquet(f"{target}/done/{batch}")


def unpack_arriving(spark: SparkSession, source: str, target: str, checkpoint: str, batch: int = BATCH, suffix: str = ".jpg") -> StreamingQuery:
    """Read archives under ``source`` that weren't read before, ``batch`` to a micro-batch; ``members`` reads what came out.

    Ends when all there is has been read. A run that was cut short goes on from its checkpoint, and one with a new
    checkpoint passes over what the manifest names: batches are named by the query's own id, so two runs never share a folder.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", batch).option("recursiveFileLookup", "true").load(source)

    def append(rows: DataFrame, number: int) -> None:
        query = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "query"
        append_batch(rows, target, f"{query}-{number}", suffix)

    return arriving.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def wanted_archives(uids: DataFrame, index: DataFrame, done: DataFrame, kind: str = "render") -> DataFrame:
    """(uid, path) of a request's archives that aren't unpacked yet: looked up in the index, less what the manifest names."""
    return resolve(uids, index, kind).join(done.select("path"), "path", "left_anti").select("uid", "path")
