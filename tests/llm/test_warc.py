"""WARC reading: long headers over the ends of ranges, odd tables, and files that break."""

import pytest

from scorelake.llm import warc


def long_header(number: int, size: int, payload: bytes) -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{number}>\r\nX-Note: {'n' * size}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def files_of(spark, folder, **contents):
    for name, data in contents.items():
        (folder / f"{name}.warc").write_bytes(data)
    return spark.createDataFrame([(f"file://{folder}/{n}.warc", len(d)) for n, d in contents.items()], "path string, size long")


@pytest.mark.parametrize("size", [200_000, 3 << 20])
def test_a_header_of_any_length_over_the_end_of_a_range(spark, tmp_path, size):
    split = 1 << 20
    first = warc.record("resource", "urn:page:1", None, b"a" * (split - 500))
    data = first + long_header(2, size, b"two") + warc.record("resource", "urn:page:3", None, b"three")
    got = warc.records(files_of(spark, tmp_path, a=data), split).collect()
    assert {r["record_id"]: len(r["payload"]) for r in got} == {"<urn:page:1>": split - 500, "<urn:page:2>": 3, "<urn:page:3>": 5}


def test_the_work_on_a_range_is_linear():
    one = warc.record("resource", "urn:page:1", "http://a/", b"x" * 300)
    for ending in (one, one.replace(b"\r\n", b"\n"), b"WARC/1.0\r\n"):
        data = ending * (4_000_000 // len(ending))
        at, _ = warc.candidates(data, 0, len(data))
        assert len(at) == (0 if ending == b"WARC/1.0\r\n" else len(data) // len(ending))


def test_odd_tables(spark, tmp_path):
    data = warc.record("warcinfo", None, None, b"x") + warc.record("resource", "urn:page:1", "http://a/", b"one")
    files = files_of(spark, tmp_path, good=data, empty=b"", other=b"no archive at all", cut=data[:-6], headless=data[: len(data) - 40])
    nulls = spark.createDataFrame([(None, 5), (f"file://{tmp_path}/good.warc", len(data) - 3)], "path string, size long")
    for table in (files, files.union(files).union(nulls)):
        got = sorted((r["path"].rsplit("/", 1)[1], r["type"], bytes(r["payload"])) for r in warc.records(table).collect())
        assert got == [("cut.warc", "resource", b"o"), ("cut.warc", "warcinfo", b"x"), ("good.warc", "resource", b"one"), ("good.warc", "warcinfo", b"x"), ("headless.warc", "warcinfo", b"x")]
    assert warc.records(files.limit(0)).count() == 0
    assert warc.records(files.selectExpr("path", "size", "1 as start", "'x' as at")).count() == 5


def test_repeated_fields_and_line_ends(spark, tmp_path):
    odd = b"WARC/1.1\nWARC-Type: resource\nWARC-Type: other\n folded\nContent-Length: 3\n\nabc\r\n\r\n"
    got = warc.records(files_of(spark, tmp_path, a=odd + warc.record("resource", "urn:page:2", None, b"")), 64).orderBy("offset").collect()
    assert [(r["type"], bytes(r["payload"])) for r in got] == [("resource", b"abc"), ("resource", b"")]


def test_paths_with_odd_characters(spark, tmp_path):
    (tmp_path / "a folder").mkdir()
    got = warc.records(files_of(spark, tmp_path / "a folder", **{"50% #1": warc.record("resource", "urn:page:1", None, b"x")})).collect()
    assert [bytes(r["payload"]) for r in got] == [b"x"]


def test_written_files_are_noted_for_deletion(spark):
    from scorelake.llm import _common

    folder = warc.folder_of(spark, "noted")
    assert folder in [p for _, p in _common._written]
