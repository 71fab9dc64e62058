"""Signals: WAV and FLAC files and uncompressed archives as (key, rate, samples)."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples of a batch of signals.
BATCH = 1 << 19
SCHEMA = "key string, rate int, samples array<double>, error string"


def decode_wav(data: bytes, mono: bool = False) -> tuple[int, np.ndarray]:
    """(rate, first channel, or the channels' mean with ``mono``): 16-bit samples over 32767, other widths as they are."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width, n = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()
        raw = w.readframes(n)
    kind = {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}.get(width)
    if kind is None:
        raise ValueError(f"{width * 8} bits a sample")
    x = np.frombuffer(raw, kind).reshape(-1, channels).astype(float)
    x = x.mean(axis=1) if mono else x[:, 0]
    return rate, x / 32767 if width == 2 else x


def decode_signal(data: bytes, mono: bool = False) -> tuple[int, np.ndarray]:
    """(rate, first channel or mean) of a WAV or FLAC file."""
    if data is not None and data[:4] == b"fLaC":
        from scorelake.sources.flac import decode_flac

        rate, width, x = decode_flac(data)
        x = x.mean(axis=1) if mono else x[:, 0].astype(float)
        return rate, x / 32767 if width == 16 else x
    return decode_wav(data, mono)


def encode_wav(rate: int, samples: np.ndarray) -> bytes:
    """16-bit mono WAV; values are cut to [-1, 1]."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.round(np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def open_at(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and place of a path or URI; a local one may hold any characters."""
    if "://" not in path or path.startswith("file://"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path
    return pafs.FileSystem.from_uri(path.replace(" ", "%20"))


def is_file(path: str) -> bool:
    try:
        fs, where = open_at(path)
        return fs.get_file_info(where).type == pafs.FileType.File
    except (OSError, pa.ArrowException):
        return False


def _signals(found: Iterator[tuple[str, Callable[[], tuple[int | None, np.ndarray]]]]) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH samples of (key, how to read it); an item that can't be read has its reason."""
    rows, held = [], 0
    for key, read in found:
        try:
            rate, samples = read()
            rows.append((key, rate, samples, None))
            held += len(samples)
        except (OSError, wave.Error, ValueError, TypeError, EOFError, IndexError, struct.error, pa.ArrowException) as e:
            rows.append((key, None, None, str(e) or type(e).__name__))
        if held > BATCH or len(rows) >= 4096:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "rate", "samples", "error"])


def load(listing: DataFrame, mono: bool = False) -> DataFrame:
    """(key, rate, samples, error) of (key, path): a file that can't be decoded has its reason and no signal.

    Tasks open the files themselves, by the scheme of their path; nothing of the listing goes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(path: str) -> tuple[int, np.ndarray]:
            fs, where = open_at(path)
            with fs.open_input_stream(where) as f:
                return decode_signal(f.read(), mono)

        yield from _signals((k, partial(read, p)) for b in batches for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))

    return listing.select(F.col("key").cast("string"), "path").mapInArrow(run, SCHEMA)


def decode(media: DataFrame, key: str = "key", content: str = "content") -> DataFrame:
    """(key, rate, samples, error) of a column of WAV or FLAC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _signals((k, partial(decode_signal, d)) for b in batches for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))

    return media.select(F.col(key).cast("string"), F.col(content)).mapInArrow(run, SCHEMA)


def read_ark(spark: SparkSession, scp: str) -> DataFrame:
    """(key, path, offset) of an scp that points into archives as path:offset."""
    from scorelake.sources.listings import read_scp

    at = F.regexp_extract("path", r"^(.*?)(?::(\d+))?$", 2)
    return read_scp(spark, scp).select("key", F.regexp_extract("path", r"^(.*?)(?::(\d+))?$", 1).alias("path"), F.coalesce(F.nullif(at, F.lit("")).cast("long"), F.lit(0).cast("long")).alias("offset"))


def decode_entry(f) -> tuple[int | None, np.ndarray]:
    """(rate, samples) of the archive entry at which an open file stands: WAV, or a binary vector or matrix of numbers, whose rate isn't known."""
    head = f.read(4)
    if head == b"RIFF":
        size = f.read(4)
        return decode_wav(head + size + f.read(struct.unpack("<I", size)[0]))
    if head[:2] != b"\0B" or head[2:3] not in b"FD" or head[3:4] not in b"VM":
        raise ValueError("neither WAV nor an uncompressed vector or matrix")
    f.read(1)
    kind = np.dtype("<f4" if head[2:3] == b"F" else "<f8")
    n = 1
    for _ in range(1 if head[3:4] == b"V" else 2):
        width, value = struct.unpack("<bi", f.read(5))
        if width != 4:
            raise ValueError("sizes of an entry have 4 bytes")
        n *= value
    data = f.read(n * kind.itemsize)
    if len(data) < n * kind.itemsize:
        raise EOFError("an entry is cut off")
    return None, np.frombuffer(data, kind).astype(float)


def load_ark(listing: DataFrame) -> DataFrame:
    """(key, rate, samples, error) of archive entries (key, path, offset); a matrix's rows come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(path: str, at: int) -> tuple[int | None, np.ndarray]:
            fs, where = open_at(path)
            with fs.open_input_file(where) as f:
                f.seek(at)
                return decode_entry(f)

        yield from _signals((k, partial(read, p, o)) for b in batches for k, p, o in zip(*(b.column(c).to_pylist() for c in range(3))))

    return listing.select("key", "path", "offset").mapInArrow(run, SCHEMA)


def write_signals(signals: DataFrame, folder: str) -> DataFrame:
    """(key, path): each (key, rate, samples) as a WAV file <key>.wav below a folder; a key's slashes make folders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_at(folder)
        for batch in batches:
            keys, paths = batch.column(0).to_pylist(), []
            for k, r, x in zip(keys, batch.column(1).to_pylist(), batch.column(2)):
                name = f"{base}/{k}.wav"
                fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(name) as f:
                    f.write(encode_wav(r, np.asarray(x.values, float)))
                paths.append(f"{folder.rstrip('/')}/{k}.wav")
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(paths, pa.string())], ["key", "path"])

    return signals.select(F.col("key").cast("string"), "rate", F.col("samples").cast("array<double>")).mapInArrow(run, "key string, path string")
