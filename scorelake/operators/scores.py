"""Score tables: long and wide forms, summaries, statistics, analysis, trees and correlations.

The long form (key, metric, value) is the inner one: names are data there, so ragged rows and new
metrics need no schema change, and every aggregate is one hash aggregation by metric.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions import naming
from scorelake.functions.columns import INF, finite, is_count_metric, sample_std

#: Bins of the charts of one metric, and of several side by side.
BINS, GROUPED_BINS = 20, 15
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, key: Sequence[str] = ("key",), booleans: bool = False) -> list[str]:
    """Names of the numeric columns in order; booleans are numbers to discovery but not to the summary."""
    kinds = (*_NUMBERS, T.BooleanType) if booleans else _NUMBERS
    return sorted(f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in key)


def to_long(df: DataFrame, key: Sequence[str] = ("key",), columns: Sequence[str] | None = None, booleans: bool = False) -> DataFrame:
    """(key..., metric, value) of the non-null numbers of a wide table."""
    names = list(columns) if columns is not None else numeric_columns(df, key, booleans)
    cast = df.select(*key, *(F.col(n).cast("int").cast("double").alias(n) if isinstance(df.schema[n].dataType, T.BooleanType) else F.col(n).cast("double").alias(n) for n in names))
    return cast.unpivot(list(key), names, "metric", "value").filter("value is not null")


def to_wide(long: DataFrame, key: Sequence[str] = ("key",), metrics: Sequence[str] | None = None) -> DataFrame:
    """One column a metric; naming ``metrics`` saves the pass that finds them. Of repeated cells the last in value order stays."""
    grouped = long.groupBy(*key)
    return (grouped.pivot("metric", list(metrics)) if metrics is not None else grouped.pivot("metric")).agg(F.max("value"))


def summary(long: DataFrame) -> DataFrame:
    """(metric, value): sums of error counts, means of everything else. NaN and infinities carry through; no rows give none."""
    return long.groupBy("metric").agg(F.sum("value").alias("s"), F.avg("value").alias("a")).select("metric", F.when(is_count_metric("metric"), F.col("s")).otherwise(F.col("a")).alias("value"))


def summary_wide(df: DataFrame, key: Sequence[str] = ("key",)) -> DataFrame:
    """The summary as one row, without leaving the wide form."""
    names = numeric_columns(df, key)
    return df.agg(*((F.sum(F.col(n).cast("double")) if any(p in n for p in ("_wer", "_cer", "_per")) else F.avg(n)).alias(n) for n in names))


def strict_means(df: DataFrame, key: Sequence[str] = ("key",)) -> DataFrame:
    """Mean of every column but the key over all rows; a text column or a missing value is an error."""
    wrong = [f.name for f in df.schema.fields if f.name not in key and not isinstance(f.dataType, _NUMBERS)]
    if wrong:
        raise TypeError(f"columns without numbers: {wrong}")
    names = [c for c in df.columns if c not in key]
    return df.agg(*(F.avg(F.when(F.col(n).isNull(), F.raise_error(F.lit(f"a row has no {n}")).cast("double")).otherwise(F.col(n).cast("double"))).alias(n) for n in names))


def statistics(long: DataFrame) -> DataFrame:
    """(metric, count, mean, median, std, min, max) of the finite values; metrics without any have count 0 and nulls."""
    v = F.when(finite("value"), F.col("value"))
    raw = long.groupBy("metric").agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))
    middle = quantiles(long, [0.5]).select(F.col("metric").alias("__metric"), F.col("q")[0].alias("median"))
    both = raw.join(middle, F.col("metric").eqNullSafe(F.col("__metric")), "left")
    return both.select("metric", "count", "mean", "median", F.when(F.col("count") > 0, sample_std(F.col("count"), F.col("min"), F.col("max"), F.col("sd"))).alias("std"), "min", "max")


def quantiles(long: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(metric, q): exact interpolated quantiles of each metric's finite values; metrics without any have no row.

    Equal values are counted first; the distinct ones are sorted over ranges, so that a metric with most
    of the rows lies in many tasks, and written. A value's ranks are the counts before it: those of
    earlier ranges, from one row a metric and range, and those in its own.
    """
    from scorelake.plans.session import shared_folder

    spark = long.sparkSession
    path = shared_folder(spark, "quantiles")
    counted = long.filter(finite("value")).select("metric", (F.col("value") + 0.0).alias("value")).groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))
    counted.orderBy("metric", "value").write.parquet(path)
    rows = spark.read.schema("metric string, value double, n long").parquet(path).withColumn("part", F.col("_metadata.file_name"))
    sums = rows.groupBy("metric", "part").agg(F.sum("n").alias("n"))
    parts = Window.partitionBy("metric")
    sums = sums.select(F.col("metric").alias("m"), F.col("part").alias("p"), (F.sum("n").over(parts.orderBy(F.length("part"), "part")) - F.col("n")).alias("before"), F.sum("n").over(parts).alias("total"))
    placed = rows.join(sums, F.col("metric").eqNullSafe(F.col("m")) & (F.col("part") == F.col("p")))
    upto = F.sum("n").over(Window.partitionBy("metric", "part").orderBy("value")) + F.col("before")
    placed = placed.select("metric", "value", (upto - F.col("n")).alias("lo"), upto.alias("hi"), "total")
    spots = [F.lit(float(s)) * (F.col("total") - 1) for s in shares]
    holds = lambda r: (F.col("lo") <= r) & (F.col("hi") > r)
    ends = [(holds(F.floor(s)), holds(F.ceil(s))) for s in spots]
    some = [e for pair in ends for e in pair]
    wanted = placed.filter(reduce(lambda a, b: a | b, some))
    picked = wanted.groupBy("metric").agg(F.max("total").alias("total"), *(F.max(F.when(e, F.col("value"))).alias(f"e{i}") for i, e in enumerate(some)))
    between = [F.col(f"e{2 * i}") + (F.col(f"e{2 * i + 1}") - F.col(f"e{2 * i}")) * (s - F.floor(s)) for i, s in enumerate(spots)]
    return picked.select("metric", F.array(*between).alias("q"))


def analysis(long: DataFrame) -> DataFrame:
    """Statistics with range, cv, direction, best and worst value, variability and notes.

    A metric without a finite value has a row of nulls with variability ``invalid``.
    """
    name = F.col("metric")
    s = statistics(long).withColumns({"range": F.col("max") - F.col("min"), "cv": F.when(F.col("mean") != 0, F.try_divide("std", "mean")).when(F.col("mean") == 0, F.lit(INF)), "higher_is_better": naming.higher_is_better(name)})
    up, some = F.col("higher_is_better"), F.col("count") > 0
    return s.select(
        F.col("metric").alias("metric_name"), naming.category(name).alias("category"), "count", "mean", "median", "std", "min", "max", "range", "cv",
        F.when(some, naming.variability(F.col("cv"))).otherwise("invalid").alias("variability"),
        F.when(some, naming.quality_note(F.col("cv"))).alias("quality_note"),
        F.when(some, naming.range_note(name, F.col("min"), F.col("max"))).alias("range_note"),
        "higher_is_better",
        F.when(up, F.col("max")).when(~up, F.col("min")).alias("best_value"),
        F.when(up, F.col("min")).when(~up, F.col("max")).alias("worst_value"),
    )


def discover(long: DataFrame) -> DataFrame:
    """(metric, category) of every name that is a metric."""
    return long.select("metric").distinct().filter(~naming.ignored(F.col("metric"))).withColumn("category", naming.category(F.col("metric")))


def filter_metrics(found: DataFrame, categories: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    """Discovered metrics whose category and name hold one of the parts, whatever the case; no parts, no restriction."""
    any_of = lambda c, parts: F.lit(True) if not parts else F.exists(F.array(*(F.lit(p.lower()) for p in parts)), lambda p: F.contains(F.lower(c), p))
    return found.filter(any_of(F.col("category"), categories) & any_of(F.col("metric"), names))


def category_rollup(found: DataFrame) -> DataFrame:
    """(category, value, mean, std) of an analysis: number of metrics, mean of means, mean of deviations."""
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("value"), F.avg("mean").alias("mean"), F.avg("std").alias("std"))


def tree(found: DataFrame, root: str = "Metrics") -> DataFrame:
    """(name, parent, value, mean, std): root, categories and metrics of an analysis as an adjacency list.

    Grouping sets of one aggregation give all three levels, so the analysis runs once. An empty
    analysis has the root alone.
    """
    level = F.grouping_id()
    g = found.groupingSets([[], [F.col("category")], [F.col("category"), F.col("metric_name")]], "category", "metric_name")
    rows = g.agg(level.alias("level"), F.count("metric_name").alias("n"), F.bround(F.max("mean"), 4).alias("m"), F.bround(F.max("std"), 4).alias("s"))
    leaf = F.col("level") == 0
    name = F.when(F.col("level") == 3, F.lit(root)).when(F.col("level") == 1, F.col("category")).otherwise(F.col("metric_name"))
    parent = F.when(F.col("level") == 3, F.lit("")).when(F.col("level") == 1, F.lit(root)).otherwise(F.col("category"))
    nodes = rows.select(name.alias("name"), parent.alias("parent"), F.when(leaf, F.lit(1)).otherwise(F.col("n")).cast("long").alias("value"), F.when(leaf, F.col("m")).alias("mean"), F.when(leaf, F.col("s")).alias("std"))
    # grouping sets of nothing are nothing: the root is there all the same
    top = found.sparkSession.range(1).select(F.lit(root).alias("name"), F.lit("").alias("parent"), F.lit(0).cast("long").alias("value"), *(F.lit(None).cast("double").alias(c) for c in ("mean", "std")))
    return nodes.unionByName(top).groupBy("name", "parent").agg(*(F.max(c).alias(c) for c in ("value", "mean", "std")))


def correlation(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of each pair of columns over rows where both are finite; null where one is constant.

    All pairs come out of one aggregation pass over the wide table.
    """
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i:]]
    both = lambda a, b, x: F.when(finite(F.col(a).cast("double")) & finite(F.col(b).cast("double")), F.col(x).cast("double"))
    row = df.agg(*(F.corr(both(a, b, a), both(a, b, b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    items = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.a", "x.b", F.nanvl("x.r", F.lit(None)).alias("r"))


def positional_correlation(long: DataFrame, order: str) -> DataFrame:
    """(a, b, r) where values are paired by their place among a metric's finite values, cut to the shortest metric.

    For compatibility: the pairing has no meaning where rows lack a value. Places come from ranges of
    (metric, order), not from one window a metric; all metrics' values of a place meet in one row.
    """
    from scorelake.operators.pairing import numbered
    from scorelake.plans.session import staged

    rows = staged(numbered(long.filter(finite("value")).select("metric", F.col(order).alias("__order"), "value"), "metric", "__order", name="place"), "places")
    # a row a metric
    firsts = rows.groupBy("metric").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("m"))
    names = sorted(r["metric"] for r in firsts.select("metric").collect())
    if not names:
        return long.sparkSession.createDataFrame([], "a string, b string, r double")
    least = firsts.agg(F.min("m")).first()[0]
    placed = rows.join(firsts, "metric").select("metric", "value", (F.col("place") - F.col("first")).alias("n")).filter(F.col("n") < least)
    columns = {m: f"m{i}" for i, m in enumerate(names)}
    table = placed.groupBy("n").agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(c) for m, c in columns.items()))
    found = correlation(table, list(columns.values()))
    back = F.create_map(*(F.lit(x) for c in ((c, m) for m, c in columns.items()) for x in c))
    return found.select(back[F.col("a")].alias("a"), back[F.col("b")].alias("b"), "r")


def histogram(long: DataFrame, bins: int = BINS) -> DataFrame:
    """(metric, bin, low, high, count): equal bins between a metric's least and greatest finite value; empty bins have no row."""
    v = long.filter(finite("value"))
    edges = v.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    return v.join(edges, "metric").groupBy("metric", "lo", "hi", place.alias("bin")).agg(F.count(F.lit(1)).alias("count")).select("metric", "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "count")


def quartiles(long: DataFrame) -> DataFrame:
    """(metric, q1, q2, q3) of finite values, interpolated; metrics without any have no row."""
    return quantiles(long, [0.25, 0.5, 0.75]).select("metric", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"))


def first_category(categories: DataFrame) -> DataFrame:
    """(metric, category): of the (category, metrics, ord) groups the first in ``ord`` that holds a metric."""
    each = categories.select("category", "ord", F.explode("metrics").alias("metric"))
    return each.groupBy("metric").agg(F.min_by("category", "ord").alias("category"))


def preview(df: DataFrame, order: Column | str | Sequence[str], rows: int = 20, metrics: int = 15, key: Sequence[str] = ("key",)) -> DataFrame:
    """The first rows with the first metrics by name: a report, so it is limited. Rows that tie in ``order`` come in any order."""
    return df.orderBy(order).limit(rows).select(*key, *numeric_columns(df, key)[:metrics])


def selection(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, mean) for each wanted name in a tree; 0.0 for one that it lacks."""
    return wanted.select("name").distinct().join(nodes.select("name", "mean"), "name", "left").select("name", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def encoded_infinities(df: DataFrame) -> DataFrame:
    """Floating columns as text with inf and -inf spelt out, for JSON; NaN stays NaN."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        out.append(F.when(c == INF, "inf").when(c == -INF, "-inf").otherwise(c.cast("string")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c)
    return df.select(*out)
