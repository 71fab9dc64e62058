"""Joins of generated items with references, transcripts and earlier results, by key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def last_wins(df: DataFrame, order: Column | str, key: str = "key") -> DataFrame:
    """One row a key: the last in ``order``."""
    row = F.struct(*(F.col(c) for c in df.columns))
    order = F.col(order) if isinstance(order, str) else order
    return df.groupBy(F.col(key).alias("__key")).agg(F.max_by(row, order).alias("__row")).select("__row.*")


def pair(gen: DataFrame, ref: DataFrame | None, key: str = "key", check: bool = True) -> DataFrame:
    """Items with their reference; items without one are skipped, extra references ignored.

    Without references the items pass. With ``check`` more items than references is an error.
    """
    if ref is None:
        return gen
    if check and gen.count() > ref.count():
        raise ValueError("there are more generated items than references")
    return gen.join(ref, key, "inner")


def unpaired(gen: DataFrame, ref: DataFrame, key: str = "key") -> DataFrame:
    """The items that ``pair`` skips."""
    return gen.join(ref, key, "left_anti")


def with_text(items: DataFrame, text: DataFrame | None, key: str = "key", column: str = "text") -> DataFrame:
    """Items with their transcript; without a transcript table, or with an empty one, the column is null."""
    if text is None or text.isEmpty():
        return items.withColumn(column, F.lit(None).cast("string"))
    return items.join(text.select(key, column), key, "inner")


def require_text(items: DataFrame, text: DataFrame, key: str = "key") -> DataFrame:
    """As ``with_text``, but a missing transcript is an error that names up to five keys."""
    missing = [r[0] for r in items.join(text, key, "left_anti").select(key).orderBy(key).limit(5).collect()]
    if missing:
        raise ValueError(f"no text for {missing}")
    return items.join(text, key, "inner")


def to_do(items: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Items without a row in earlier results."""
    return items.join(done.select(key), key, "left_anti")


def resumed(items: DataFrame, done: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Earlier rows of items still listed, and the new rows; columns that one side lacks are null."""
    return done.join(items.select(key), key, "left_semi").unionByName(new, allowMissingColumns=True)


def merge_metrics(keys: DataFrame, frames: Iterable[DataFrame], key: str = "key") -> DataFrame:
    """Every key with the columns of each metric's frame; of columns with one name the later frame's wins where it has the key.

    All frames go through one shuffle by key: they are stacked, then each key's values are picked.
    """
    frames = list(frames)
    names = list(dict.fromkeys(c for f in frames for c in f.columns if c != key))
    stacked = keys.select(key).distinct().withColumn("__at", F.lit(-1))
    for i, f in enumerate(frames):
        stacked = stacked.unionByName(f.withColumn("__at", F.lit(i)), allowMissingColumns=True)
    has = {n: [i for i, f in enumerate(frames) if n in f.columns] for n in names}
    picked = stacked.groupBy(key).agg(F.max(F.col("__at") == -1).alias("__listed"), *(F.max_by(n, F.when(F.col("__at").isin(has[n]), F.col("__at"))).alias(n) for n in names))
    return picked.filter("__listed").drop("__listed")


def all_pairs(items: DataFrame, key: str = "key", vector: str = "embedding", rows: int = 2048) -> DataFrame:
    """(a, b, similarity): cosine of every pair a < b, over pairs of blocks of about ``rows`` so that no task holds a whole side.

    The vectors are written once to the shared folder, a file a block, and a task reads the blocks of
    its pair: what is moved and kept on disk is the input, however many pairs of blocks there are.
    Each pair of blocks is a product of matrices. Vectors of one length, keys without repetition; a
    norm of 0 gives NaN. The output is quadratic; above some 100,000 items use a nearest-neighbour
    search instead.
    """
    from scorelake.plans.session import shared_folder
    from scorelake.sources.audio import open_at

    spark, kind = items.sparkSession, items.schema[key].dataType
    blocks = max(1, -(-items.count() // rows))
    path = shared_folder(spark, "blocks")
    base = items.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    base.repartition("block").write.partitionBy("block").parquet(path)
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType())])

    def read(block: int) -> tuple[pa.Array, np.ndarray, np.ndarray] | None:
        fs, where = open_at(f"{path}/block={block}")
        found = pafs.FileSelector(where, allow_not_found=True)
        parts = [pq.ParquetFile(fs.open_input_file(f.path)).read(["k", "v"]) for f in fs.get_file_info(found) if f.base_name.endswith(".parquet")]
        if not parts:
            return None
        table = pa.concat_tables(parts).combine_chunks()
        keys, vectors = (pa.concat_arrays(table[c].chunks) for c in ("k", "v"))
        x = np.asarray(vectors.flatten(), np.float64).reshape(len(keys), -1)
        return keys, x, np.linalg.norm(x, axis=1)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, one = None, None
        for place in (p for b in batches for p in b.column(0).to_pylist()):
            i, j = divmod(place, blocks)
            if i != held:
                held, one = i, read(i)
            two = one if i == j else read(j)
            if one is None or two is None:
                continue
            step = max(1, (1 << 17) // len(two[0]))  # pairs of a batch
            for lo in range(0, len(one[0]), step):
                x, norm = one[1][lo : lo + step], one[2][lo : lo + step]
                with np.errstate(invalid="ignore", divide="ignore"):
                    similarity = (x @ two[1].T) / (norm[:, None] * two[2][None])
                a = one[0].take(pa.array(np.repeat(np.arange(lo, lo + len(x)), len(two[0]))))
                b = two[0].take(pa.array(np.tile(np.arange(len(two[0])), len(x))))
                least = pc.less(a, b)
                batch = pa.RecordBatch.from_arrays([a, b, pa.array(similarity.reshape(-1))], ["a", "b", "similarity"])
                yield batch.filter(least) if i == j else pa.RecordBatch.from_arrays([pc.if_else(least, a, b), pc.if_else(least, b, a), batch.column(2)], ["a", "b", "similarity"])

    pairs = spark.range(0, blocks * blocks, 1, min(blocks * blocks, 10_000)).filter(F.expr(f"id div {blocks} <= id % {blocks}"))
    return pairs.mapInArrow(cells, schema)


def sizes(one: DataFrame, two: DataFrame) -> DataFrame:
    """(baseline, evaluation, same): how many rows two independent sets have."""
    a = one.agg(F.count(F.lit(1)).alias("baseline"))
    b = two.agg(F.count(F.lit(1)).alias("evaluation"))
    return a.crossJoin(b).withColumn("same", F.col("baseline") == F.col("evaluation"))  # one row each


def concat(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of the parts of a split run."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def numbered(df: DataFrame, *order: Column | str, name: str = "ord") -> DataFrame:
    """Rows with their place, from 1 on, in the order given; of rows that tie any may come first.

    The rows are sorted over ranges and written, a file a range; a row's place is the number of rows
    in earlier files plus its place in its own. So no task sees more than its range.
    """
    from scorelake.plans.session import shared_folder

    spark = df.sparkSession
    path = shared_folder(spark, "numbered")
    df.orderBy(*order).write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = rows.groupBy("__file").count()
    # a row a file
    before = sizes.withColumn("__before", F.sum("count").over(Window.orderBy(F.length("__file"), "__file")) - F.col("count")).select("__file", "__before")
    return rows.join(before, "__file").select(*df.columns, (F.col("__before") + F.col("__row") + 1).alias(name))
