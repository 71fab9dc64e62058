"""Score files as a stream: a running summary, and keyed merges that keep the last row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from scorelake.functions.columns import is_count_metric
from scorelake.plans.session import file_system
from scorelake.sources.scores import long_scores


def stream_scores(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """(key, metric, value) of JSON-lines files as they arrive."""
    return long_scores(spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path))


def stream_table(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def running_summary(scores: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep (metric, value) in the in-memory table ``name``: its state is one row a metric."""
    sums = scores.groupBy("metric").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    out = sums.select("metric", F.when(is_count_metric("metric"), F.col("s")).otherwise(F.try_divide("s", F.col("n").cast("double"))).alias("value"))
    return out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_summary(scores: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, metric, count, mean) of event-time windows; rows later than ``late`` are dropped."""
    return scores.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "metric").agg(F.count("value").alias("count"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "metric", "count", "mean")


#: Buckets of keys in a merged table.
BUCKETS = 16


def merge_latest(stream: DataFrame, target: str, checkpoint: str, order: str, key: str = "key", buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the last row of every key in Parquet at ``target``: a batch merges the buckets of the keys it holds, the others stay as they are.

    A batch's version holds the merged buckets; a batch that is run again writes the same version again,
    so a restart repeats nothing. The table is ``latest(spark, target)``: of each bucket the newest
    version. Buckets that two newer versions hold are deleted, which leaves readers of the one before
    their files.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
        new = batch.withColumn("__bucket", place)
        touched = {r[0] for r in new.select("__bucket").distinct().collect()}  # BUCKETS rows at most
        have = _bucket_paths(spark, target, number)
        old = [p[-1] for b, p in have.items() if b in touched]
        if old:
            new = new.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("__bucket", place))
        row = F.struct(*batch.columns)
        merged = new.groupBy("__bucket", F.col(key).alias("__k")).agg(F.max_by(row, F.col(order)).alias("r")).select("__bucket", "r.*")
        merged.write.mode("overwrite").partitionBy("__bucket").parquet(f"{target}/version={number:09d}")
        for b in touched & set(have):
            for path in have[b][:-1]:
                fs, where = file_system(spark, path)
                fs.delete(where, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _bucket_paths(spark: SparkSession, target: str, before: int | None = None) -> dict[int, list[str]]:
    """{bucket: its folders, oldest version first} of the complete versions, or of those before a batch."""
    fs, base = file_system(spark, target)
    out: dict[int, list[str]] = {}
    if not fs.exists(base):
        return out
    children = lambda p: sorted(s.getPath().toString() for s in fs.listStatus(file_system(spark, p)[1]))
    for version in [p for p in children(target) if "/version=" in p]:
        inside = children(version)
        if any(p.endswith("/_SUCCESS") for p in inside) and (before is None or int(version.rsplit("=", 1)[1]) < before):
            for p in inside:
                if "/__bucket=" in p:
                    out.setdefault(int(p.rsplit("=", 1)[1]), []).append(p)
    return out


def latest(spark: SparkSession, target: str) -> DataFrame | None:
    """The merged table: of each bucket the newest complete version; None before the first batch."""
    paths = [p[-1] for p in _bucket_paths(spark, target).values()]
    return spark.read.parquet(*paths) if paths else None
