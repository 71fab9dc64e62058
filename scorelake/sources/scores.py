"""Score files: JSON lines and their relatives, read into the long form, and the writers."""

from __future__ import annotations

import ast
import json
import math
from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.columns import INF
from scorelake.operators.scores import encoded_infinities
from scorelake.operators.standardize import repair_quotes
from scorelake.sources.audio import open_at

#: NaN and infinities that JSON lacks are quoted before a line is parsed.
_SPECIAL = r'(:\s*|[\[,]\s*)(-?Infinity|NaN)(?=\s*[,}\]])'
PATTERNS = ("*.jsonl", "*.json", "*.jl", "*.txt")


def variant(line: Column) -> Column:
    """A line as VARIANT; null where it isn't JSON. Infinity and NaN become strings of those names."""
    special = line.contains("Infinity") | line.contains("NaN")
    return F.try_parse_json(F.when(special, F.regexp_replace(line, _SPECIAL, '$1"$2"')).otherwise(line))


def as_number(value: Column, booleans: bool = False) -> Column:
    """The number in a VARIANT as DOUBLE, also NaN and infinities; null for anything else."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(value, "$", "double"))
    number = number.when((kind == "STRING") & (text == "NaN"), F.lit(float("nan"))).when((kind == "STRING") & (text == "Infinity"), F.lit(INF)).when((kind == "STRING") & (text == "-Infinity"), F.lit(-INF))
    return number.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int").cast("double")) if booleans else number


def long_scores(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = (), booleans: bool = True) -> DataFrame:
    """(key, metric, value, keep...) of every number of JSON lines; blank and bad lines and other values give none."""
    v = lines.select(*keep, variant(F.col(line)).alias("v")).filter("v is not null and schema_of_variant(v) like 'OBJECT%'")
    flat = v.lateralJoin(v.sparkSession.tvf.variant_explode(F.col("v").outer())) if hasattr(v.sparkSession, "tvf") else v
    number = as_number(F.col("value"), booleans)
    rows = flat.select(F.try_variant_get("v", "$.key", "string").alias("key"), F.col("key").alias("metric"), number.alias("value"), *keep)
    return rows.filter("value is not null and metric != 'key'")


def read_scores(spark: SparkSession, path: str, folder: bool = False) -> DataFrame:
    """(key, metric, value, source_file) of a score file, or of all score files in a folder."""
    reader = spark.read
    if folder:
        reader = reader.option("pathGlobFilter", "{" + ",".join(PATTERNS) + "}")
    lines = reader.text(path).select("value", F.col("_metadata.file_name").alias("source_file"))
    return long_scores(lines, keep=("source_file",))


def bad_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """The lines that readers skip: neither blank nor a JSON object with a key."""
    v = variant(F.col(line))
    return lines.filter((F.trim(line) != "") & (v.isNull() | F.try_variant_get(v, "$.key", "string").isNull()))


def read_done(spark: SparkSession, path: str) -> DataFrame:
    """(key, line): the last line of every key of a result file or folder, for resuming; bad lines are skipped.

    Files come in the order in which they were written, lines in that of their file.
    """
    place = F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(path).select("value", place.alias("place"))
    keyed = lines.withColumn("key", F.try_variant_get(variant(F.col("value")), "$.key", "string")).filter("key is not null")
    return keyed.groupBy("key").agg(F.max_by("value", "place").alias("line"))


def literal_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """(value): lines as JSON, from JSON, Python literals or single-quoted dicts; others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                fixed = to_json(t)
                if fixed is not None:
                    out.append(fixed)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    # JSON lines need no Python: only what doesn't parse goes through the repair
    v = variant(F.col(line))
    good = lines.filter(v.isNotNull()).select(F.col(line).alias("value"))
    return good.union(lines.filter(v.isNull() & (F.trim(line) != "")).select(line).mapInArrow(run, "value string"))


def to_json(text: str | None) -> str | None:
    if text is None or not text.strip():
        return None
    try:
        return json.dumps(json.loads(text))
    except ValueError:
        pass
    try:
        # bare inf and nan are names, not literals
        tree = ast.parse(text.strip(), mode="eval")
        return json.dumps(_value(tree.body))
    except (ValueError, SyntaxError, RecursionError, MemoryError):
        return repair_quotes(text)


def _value(node: ast.AST):
    if isinstance(node, ast.Name) and node.id in ("inf", "nan", "Infinity", "NaN"):
        return math.inf if node.id.lower().startswith("inf") else math.nan
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return -_value(node.operand)
    if isinstance(node, ast.Dict):
        return {_value(k): _value(v) for k, v in zip(node.keys, node.values)}
    if isinstance(node, (ast.List, ast.Tuple)):
        return [_value(e) for e in node.elts]
    return ast.literal_eval(node)


def score_scp(lines: DataFrame, line: str = "value") -> DataFrame:
    """(key, scores): lines of an id and a JSON object, as VARIANT; lines without one are left out."""
    parts = F.split(F.trim(line), " ", 2)
    return lines.select(parts[0].alias("key"), variant(F.get(parts, F.lit(1))).alias("scores")).filter("scores is not null")


def regex_scores(lines: DataFrame, line: str = "value", compat: bool = False) -> DataFrame:
    """(metric, value) of every 'name': number in free text; infinities are dropped. ``compat`` knows no sign and no exponent."""
    number = r"\d+(?:\.\d+)?" if compat else r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
    pattern = F.lit(r"'([A-Za-z0-9_]+)':\s*(" + number + r")(?=\s*[,}])")
    names, values = F.regexp_extract_all(line, pattern, F.lit(1)), F.regexp_extract_all(line, pattern, F.lit(2))
    return lines.select(F.explode(F.arrays_zip(names.alias("metric"), values.alias("value"))).alias("x")).select("x.metric", F.col("x.value").cast("double").alias("value"))


def json_to_transcript(lines: DataFrame, key_path: str = "$.segment_index", text_path: str = "$.local_scene", line: str = "value") -> DataFrame:
    """(key, text) at dotted paths, text cleaned; rows without key or text are left out, sorted by key."""
    from scorelake.functions.columns import clean_transcript

    # one row or none: a filter would be pushed below and parse each line anew for each of its conditions
    parsed = F.transform(F.array(variant(F.col(line))), lambda v: F.struct(F.try_variant_get(v, key_path, "string").alias("key"), clean_transcript(F.try_variant_get(v, text_path, "string")).alias("text")))
    rows = lines.select(F.inline(F.filter(parsed, lambda r: (r["key"] != "") & (r["text"] != ""))))
    return rows.orderBy("key")


def described(df: DataFrame, key: str = "key", answer: str = "answer") -> DataFrame:
    """(key, description, error, raw): a model's answer without its fence as VARIANT; one that isn't JSON has an error and its text."""
    from scorelake.functions.columns import unfenced

    v = F.try_parse_json(unfenced(answer))
    return df.select(key, v.alias("description"), F.when(v.isNull(), F.lit("not JSON")).alias("error"), F.when(v.isNull(), F.col(answer)).alias("raw"))


def prompt(scores: Column | str) -> Column:
    """What a text model is asked about one item's scores (JSON text)."""
    return F.concat(F.lit("Describe the recording that has these scores, as a JSON object.\nScores: "), F.col(scores) if isinstance(scores, str) else scores)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, nulls kept; with ``append`` as further files beside those that are there."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def replace_jsonl(df: DataFrame, path: str) -> None:
    """The whole table as JSON lines in place of what is at ``path``: written beside it first, then renamed, so readers never see a part."""
    import uuid

    from scorelake.plans.session import file_system

    made = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    write_jsonl(df, made)
    fs, target = file_system(df.sparkSession, path)
    _, new = file_system(df.sparkSession, made)
    _, old = file_system(df.sparkSession, made + "-old")
    had = fs.exists(target)
    if had:
        fs.rename(target, old)
    fs.rename(new, target)
    if had:
        fs.delete(old, True)


def write_analysis(df: DataFrame, path: str) -> None:
    """JSON lines with infinities as text."""
    encoded_infinities(df).write.mode("overwrite").json(path)


def write_statistics(df: DataFrame, path: str) -> None:
    """The analysis as one CSV file with a header, sorted by name."""
    df.orderBy("metric_name").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_corpus(row: dict[str, float], path: str) -> None:
    """Scores of a corpus as a YAML file, at a path or URI."""
    fs, where = open_at(path)
    with fs.open_output_stream(where) as f:
        f.write(yaml.safe_dump(row).encode())


def _yaml(path: str):
    fs, where = open_at(path)
    with fs.open_input_stream(where) as f:
        return yaml.safe_load(f.read())


def read_corpus(path: str) -> dict[str, float]:
    return _yaml(path) or {}


def read_config(path: str) -> list[dict]:
    """The list of metrics to apply, each with its options."""
    found = _yaml(path)
    if not isinstance(found, list) or not all(isinstance(x, dict) and "name" in x for x in found):
        raise ValueError("a configuration is a list of metrics with a name each")
    return found
