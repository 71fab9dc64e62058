"""Listings and transcripts: key, then a value, on each line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.sources.audio import is_file

AUDIO = ("*.flac", "*.wav")


def parsed_lines(lines: DataFrame, line: str = "value", order: str | None = None, value: str = "path", pipes: bool = False) -> DataFrame:
    """(key, value) of lines of a key, white space and a value; of lines with one key the last in ``order`` stays.

    A blank line or one without a value is an error, and so is a command (a value that ends in a
    pipe) unless ``pipes``.
    """
    parts = F.split(F.trim(F.regexp_replace(F.col(line), r"[\s]+$", "")), r"\s+", 2)
    bad = lambda text: F.raise_error(F.concat(F.lit(text), F.coalesce(F.col(line), F.lit("null")))).cast("string")
    second = F.when(F.size(parts) == 2, F.trim(parts[1])).otherwise(bad("a line needs a key and a value: "))
    if not pipes:
        second = F.when((F.size(parts) == 2) & F.trim(F.element_at(parts, -1)).endswith("|"), bad("commands aren't run: ")).otherwise(second)
    rows = lines.select(parts[0].alias("key"), second.alias(value), (F.col(order) if order else F.monotonically_increasing_id()).alias("__n"))
    return rows.groupBy("key").agg(F.max_by(value, "__n").alias(value))


def _in_order(spark: SparkSession, path: str) -> DataFrame:
    """(value, place) of the lines of a file or folder: places follow files by name, and lines in a file."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return spark.read.text(path).select("value", place.alias("place"))


def read_scp(spark: SparkSession, path: str) -> DataFrame:
    """(key, path) of a listing, read in as many tasks as it has blocks."""
    return parsed_lines(_in_order(spark, path), order="place")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(key, text) of a transcript file."""
    return parsed_lines(_in_order(spark, path), order="place", value="text", pipes=True)


def read_directory(spark: SparkSession, root: str, patterns: tuple[str, ...] = AUDIO) -> DataFrame:
    """(key, path) of the files under a folder: the key is the path from the root, so equal names in two folders stay apart."""
    base = root.rstrip("/")
    return _listed(spark, base, patterns).select(_below(F.col("path"), base).alias("key"), "path")


def _listed(spark: SparkSession, base: str, patterns: tuple[str, ...]) -> DataFrame:
    glob = "{" + ",".join(patterns) + "}" if len(patterns) > 1 else patterns[0]
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(base).select("path", F.col("length").alias("size"))


def _below(path: Column, base: str) -> Column:
    return F.regexp_replace(path, "^(?:file:)?/*" + re.escape(base.split(":", 1)[-1].lstrip("/")) + "/+", "")


def directory_to_scp(spark: SparkSession, root: str, patterns: tuple[str, ...] = AUDIO) -> DataFrame:
    """(key, path) where the key is the file's name without ending; names can repeat."""
    found = _listed(spark, root.rstrip("/"), patterns)
    return found.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("key"), F.regexp_replace("path", "^file:/*", "/").alias("path"))


def read_audio_listing(spark: SparkSession, where: str, kind: str) -> DataFrame:
    """(key, path) by the kind of source: ``soundfile`` for a listing, ``dir`` for a folder."""
    if kind == "soundfile":
        return read_scp(spark, where)
    if kind == "dir":
        return read_directory(spark, where)
    if kind == "kaldi":
        from scorelake.sources.audio import read_ark

        return read_ark(spark, where)
    raise ValueError(f"unknown kind of source: {kind}")


def read_csv_list(spark: SparkSession, path: str, column: str = "file_path", existing: bool = True) -> DataFrame:
    """(path): a named column of a CSV file, trimmed; with ``existing`` only files that are there."""
    rows = spark.read.csv(path, header=True)
    if column not in rows.columns:
        raise ValueError(f"no column {column}")
    names = rows.select(F.trim(column).alias("path")).filter("path is not null and path != ''")
    if not existing:
        return names

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([p for p in paths if is_file(p)], pa.string())], ["path"])

    return names.mapInArrow(there, "path string")


def transcripts_from_librispeech(spark: SparkSession, root: str) -> DataFrame:
    """(key, text) of all *.trans.txt below a folder."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.trans.txt").text(root)
    return parsed_lines(lines, value="text", pipes=True)


def write_scp(df: DataFrame, path: str, value: str = "path") -> None:
    """Lines of key and value, sorted by key, in one file as its readers expect."""
    df.orderBy("key").select(F.concat_ws(" ", "key", value).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def transcripts_from_folder(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """(key, text) of one text file an item, the key being the file's name without ending."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    return found.select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("key"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("text"))


def fixed_splits(signals: DataFrame, seconds: float, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """(key, source, part, samples, rate): a recording cut into parts of ``seconds`` without overlap, the last one as long as it is.

    Keys are <source>_<start>_<end> in seconds, parts count from 0, and there are as many as the length
    over ``seconds`` rounded up.
    """
    total = F.size(samples) / F.col(rate)
    parts = F.when(F.size(samples) > 0, F.sequence(F.lit(0), F.ceil(total / seconds).cast("int") - 1))
    cut = signals.withColumn("part", F.explode(parts))
    start, end = F.col("part") * F.lit(seconds), (F.col("part") + 1) * F.lit(seconds)
    stop = F.when(end < total, end.cast("string")).otherwise(total.cast("string"))
    first, last = F.floor(start * F.col(rate)).cast("int"), F.floor(F.least(end, total) * F.col(rate)).cast("int")
    return cut.select(F.concat_ws("_", "key", start.cast("string"), stop).alias("key"), F.col("key").alias("source"), "part", F.slice(samples, first + 1, last - first).alias(samples), rate)


def mixtures(spark: SparkSession, root: str, seconds: float, target: int = 22_050) -> DataFrame:
    """(key, source, part, samples, rate): every mixture.wav below a folder, its channels' mean at ``target`` Hz, in parts of ``seconds``.

    A recording's key is the name of its folder, spaces as underscores.
    """
    from scorelake.functions.signal import resampled
    from scorelake.sources.audio import load

    found = _listed(spark, root.rstrip("/"), ("mixture.wav",))
    listing = found.select(F.replace(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.lit(" "), F.lit("_")).alias("key"), "path")
    signals = load(listing, mono=True).filter("error is null")
    return fixed_splits(signals.select("key", F.lit(target).alias("rate"), resampled("samples", "rate", F.lit(target)).alias("samples")), seconds)


def evaluation_archives(names: DataFrame, name: str = "path") -> DataFrame:
    """Of the files of a data set's repository the archives of its evaluation part: data..., eval, .tar."""
    c = F.col(name)
    return names.filter(c.startswith("data") & c.endswith(".tar") & c.contains("eval"))
