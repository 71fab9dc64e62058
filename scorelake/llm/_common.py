"""Session helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a batch between Spark and Python, where the session sets no bound of its own.
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where it is set.

    Where it is unset a local session gets a temporary folder; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="scorelake-")
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def kept_until_exit(spark: SparkSession, path: str) -> str:
    """Note a folder of intermediate files, which is deleted when the program ends."""
    _written.append((spark, path))
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/scorelake-{tag}-{uuid.uuid4().hex}"
    kept_until_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order, name: str) -> DataFrame:
    """Rows with their place, from 1 on, in the order given; of rows that tie any may come first.

    The rows are sorted over ranges and written, a file a range; a row's place is the number of rows of
    the files before plus its place in its own, so no task sees more than its range.
    """
    rows = staged(df.orderBy(*order), "numbered").select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    # a row a file
    sizes = rows.groupBy("__file").count()
    before = sizes.select("__file", (F.sum("count").over(Window.orderBy(F.length("__file"), "__file")) - F.col("count")).alias("__before"))
    return rows.join(before, "__file").select(*df.columns, (F.col("__before") + F.col("__row") + 1).alias(name))


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``staged`` made; only for tables nothing reads any more."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        for one in [x for x in _written if x[1].split(":")[-1].rstrip("/").endswith(path.rsplit("/", 1)[-1])]:
            _delete(*one)
            _written.remove(one)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is already gone; its folder is the cluster's to clear
            return


def release() -> None:
    """Give memory that is free but kept back to the system, so that a worker's next task starts low."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` over batches bounded by their bytes.

    A batch bounded by rows alone holds 10,000 texts of any length, twice in each of the two processes.
    """
    spark = df.sparkSession
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(tidy, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share(column: str, rate: float):
    """Condition that keeps about ``rate`` of the rows, by the hash of a column: the same rows on every run."""
    return F.pmod(F.xxhash64(F.col(column), F.lit("share")), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it as long as a column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; there are {df.columns}")
