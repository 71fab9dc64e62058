"""WARC reading by boundary-chain verification.

Tasks read byte ranges and emit, for every place that looks like the start of a record, the offset
of its successor. Inside a range the chain from each candidate is followed to the first offset
beyond it; between ranges pointer jumping from the start of the file doubles the distance each
round. Only records on the chain from offset 0 stay, so text inside a payload that looks like a
record, even a whole archive, is rejected. Files are read as they are: compressed ones have no record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm._common import discard, kept_until_exit, mapped, shared_dir, staged
from scorelake.sources.audio import open_at

#: Bytes of a range, and of what is read beyond it at first; a header that goes on further is read whole.
SPLIT, LOOK = 8 << 20, 1 << 16
#: Bytes of ranges to a task, once there are more ranges than WAVES times the cores.
TASK_BYTES, WAVES = 128 << 20, 4
_MAGIC = re.compile(rb"WARC/\d\.\d\r?\n")
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$")
_FIELD = re.compile(rb"(?m)^([A-Za-z0-9-]+):[ \t]*(.*?)[ \t]*\r?$")
#: A line of a header: a name and a colon, or white space that carries on the line before.
_LINE = re.compile(rb"[!#-'*+.0-9A-Z^-z|~-]+:|[ \t]")


class Cut(Exception):
    """The header goes on beyond the bytes at hand."""


def _header_end(data: bytes, at: int) -> int | None:
    """Where the lines of a header from ``at`` on end, its blank line included; None at a line that no header has."""
    while True:
        stop = data.find(b"\n", at)
        if stop < 0:
            raise Cut
        if stop == at or (stop == at + 1 and data[at] == 13):
            return stop + 1
        if not _LINE.match(data, at):
            return None
        at = stop + 1


def header(data: bytes, at: int) -> tuple[int, int, dict[str, str]] | None:
    """(header's length, payload's length, fields) of a record that begins at ``at``; None where none does.

    Lines are read one by one from the magic on, so the work is the header's own length. ``Cut`` where
    the data end first.
    """
    m = _MAGIC.match(data, at)
    end = _header_end(data, m.end()) if m else None
    if end is None:
        return None
    block = data[m.end() : end]
    length = _LENGTH.search(block)
    if not length or b"warc-type" not in block.lower():
        return None
    fields: dict[str, str] = {}
    for k, v in _FIELD.findall(block):
        fields.setdefault(k.decode("latin-1").lower(), v.decode("utf-8", "replace"))
    return end - at, int(length.group(1)), fields


def candidates(data: bytes, base: int, own: int, last: bool = True) -> tuple[list[int], list[int]]:
    """(offsets, successors' offsets) of what looks like a record and begins in the first ``own`` bytes.

    ``last`` says that the file ends with the data: a header that is cut off there is none. Else it raises ``Cut``.
    """
    at, nexts = [], []
    for m in _MAGIC.finditer(data, 0, min(len(data), own + 10)):
        if m.start() >= own:
            break
        try:
            found = header(data, m.start())
        except Cut:
            if not last:
                raise
            continue
        if found:
            end = m.start() + found[0] + found[1]
            at.append(base + m.start())
            nexts.append(base + end + 4)  # a record ends with two line ends
    return at, nexts


def splits(files: DataFrame, size: int = SPLIT) -> DataFrame:
    """(path, size, start) from (path, size): one row a byte range. Null paths and empty files give none; a repeated path counts once."""
    rows = files.filter("path is not null and size > 0").groupBy("path").agg(F.max("size").alias("size"))
    return rows.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long"))).alias("start"))


def tasks(files: DataFrame, size: int = SPLIT) -> int:
    """Number of tasks for the ranges: one each, until tasks of TASK_BYTES keep all cores busy."""
    sums = splits(files, size).agg(F.count(F.lit(1)).alias("n")).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    return max(1, min(sums["n"], max(WAVES * cores, sums["n"] * size // TASK_BYTES)))


def links(ranges: DataFrame, size: int = SPLIT) -> DataFrame:
    """(path, size, start, at, next, exit): candidates of each range, their successors, and where their chains leave the range.

    ``exit`` is -1 for a chain that breaks inside the range.
    """

    def read(path: str, total: int, start: int) -> tuple[list[int], list[int]]:
        fs, where = open_at(path)
        look = LOOK
        with fs.open_input_file(where) as f:
            end = min(total, f.size())
            while True:
                data = f.read_at(max(0, min(size + look, end - start)), start)
                try:
                    return candidates(data, start, size, start + len(data) >= end)
                except Cut:  # a header reaches beyond what was read
                    look *= 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, total, start in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start"))):
                at, nexts = read(path, total, start)
                index = {o: i for i, o in enumerate(at)}
                exits = [-1] * len(at)
                for i in range(len(at) - 1, -1, -1):
                    n = nexts[i]
                    if n >= min(start + size, total):
                        exits[i] = min(n, total)
                    elif n in index:
                        exits[i] = exits[index[n]]
                rows = [pa.array([x], t) for x, t in ((path, pa.string()), (total, pa.int64()), (start, pa.int64()), (at, pa.list_(pa.int64())), (nexts, pa.list_(pa.int64())), (exits, pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays(rows, ["path", "size", "start", "at", "next", "exit"])

    return mapped(ranges, run, "path string, size long, start long, at array<long>, next array<long>, exit array<long>")


def reached(found: DataFrame) -> DataFrame:
    """(path, at): the candidates at which the chain from offset 0 enters a range, by pointer jumping."""
    each = found.select("path", "size", F.explode(F.arrays_zip("at", "exit")).alias("x")).select("path", "size", "x.at", "x.exit")
    # only offsets that some chain leads to, and file starts, can be entered
    targets = each.filter("exit > 0 and exit < size").select("path", F.col("exit").alias("at")).union(each.filter("at = 0").select("path", "at")).distinct()
    jump = staged(each.join(targets, ["path", "at"]).select("path", "at", F.when((F.col("exit") > 0) & (F.col("exit") < F.col("size")), F.col("exit")).alias("to")), "jump")
    here = staged(jump.filter("at = 0").select("path", "at"), "reach")
    count = here.count()
    while jump.filter("to is not null").limit(1).count():
        step = here.join(jump, ["path", "at"]).filter("to is not null").select("path", F.col("to").alias("at")).join(jump.select("path", "at"), ["path", "at"], "left_semi")
        new = staged(here.union(step).distinct(), "reach")
        now = new.count()
        far = jump.select("path", F.col("at").alias("to"), F.col("to").alias("end"))
        double = staged(jump.join(far, ["path", "to"], "left").select("path", "at", F.col("end").alias("to")), "jump")
        discard(jump)
        discard(here)
        here, jump = new, double
        if now == count:
            break
        count = now
    return here


def records(files: DataFrame, size: int = SPLIT) -> DataFrame:
    """(path, offset, type, record_id, uri, date, payload) of every record on the chain of each file (path, size).

    A file that doesn't begin with a record has none; one whose chain breaks has those before the
    break, and a record that the file's end cuts off has what there is of its payload. Null paths and
    empty files have none, a path given twice counts once, with the larger size. Missing fields are
    null, and of a field that is repeated the first counts. An empty table gives no row. The payload
    is binary, whole; headers may have any length.
    """
    n = tasks(files, size)
    found = staged(links(splits(files, size).repartition(n), size), "links")
    entry = reached(found).select("path", (F.col("at") - F.col("at") % size).alias("start"), F.col("at").alias("entry"))
    # a number of partitions by name: the rows are few and small, so that adaptive planning would put all in one task
    chosen = found.join(entry, ["path", "start"]).select("path", "size", "start", "at", "next", "entry").repartition(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                after = dict(zip(row["at"], row["next"]))
                chain, at = [], row["entry"]
                while at in after:
                    chain.append(at)
                    at = after[at]
                fs, where = open_at(row["path"])
                with fs.open_input_file(where) as f:
                    yield from _payloads(f, row["path"], chain, after, min(row["size"], f.size()), row["start"] + size)

    def _payloads(f, path: str, chain: list[int], after: dict[int, int], total: int, stop: int) -> Iterator[pa.RecordBatch]:
        """Records of a chain: the range is read in one piece, and a record that goes beyond it apart."""
        out, held, base = [], 0, chain[0]
        data = f.read_at(max(0, min(stop, total) - base), base)
        for at in chain:
            end = min(after[at] - 4, total)
            whole = data[at - base : end - base] if end <= base + len(data) else f.read_at(max(0, end - at), at)
            head, length, fields = header(whole, 0)
            out.append((path, at, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), whole[head : head + length]))
            held += len(whole)
            if held > 4 << 20:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)

    def _batch(rows: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "offset", "type", "record_id", "uri", "date", "payload"])

    return mapped(chosen, run, "path string, offset long, type string, record_id string, uri string, date string, payload binary")


def record(kind: str, record_id: str | None, uri: str | None, payload: bytes, date: str = "2020-01-01T00:00:00Z") -> bytes:
    """One WARC record."""
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Date: {date}"]
    if record_id is not None:
        lines.append(f"WARC-Record-ID: <{record_id}>")
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", uri))
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", roll: int = 64 << 20) -> DataFrame:
    """Write pages as WARC files of about ``roll`` bytes and return (path, size) of each.

    Names hold the task's attempt, so a task that is run again writes other files and only those of
    attempts that ended are returned. A null page is a record without payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_at(folder)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId()}-{context.taskAttemptId()}"
        done: list[tuple[str, int]] = []
        out, size, number = None, 0, 0
        for batch in batches:
            for i, u, h in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if out is None:
                    target = f"{name}-{number}.warc"
                    out, size, number = fs.open_output_stream(f"{base}/{target}"), 0, number + 1
                    size += out.write(record("warcinfo", None, None, b"format: WARC File Format 1.0\r\n"))
                size += out.write(record("resource", None if i is None else f"urn:page:{i}", u, (h or "").encode()))
                if size >= roll:
                    out.close()
                    done.append((f"{folder}/{target}", size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{target}", size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "size"])

    return staged(mapped(pages.select(F.col(key), F.col(url), F.col(html)), run, "path string, size long"), "manifest")


def folder_of(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the program ends."""
    import uuid

    return kept_until_exit(spark, f"{shared_dir(spark).rstrip('/')}/scorelake-{name}-{uuid.uuid4().hex}")


def listing(spark: SparkSession, glob: str) -> DataFrame:
    """(path, size) of the files that match, without reading them."""
    return spark.read.format("binaryFile").load(glob).select("path", F.col("length").alias("size"))
