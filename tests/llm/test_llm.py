"""Operators of the llm subpackage against brute force, round trips and held-out labels, and on odd tables."""

import struct
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorelake.llm import minhash, mixing, packing, pii, queries, secrets, tiff, tokens, toxicity, warc
from scorelake.llm._common import table

TABLES = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __gone string, __rate string, __copy int, __toxic_score string, sig string"
LONG = "lorem ipsum dolor sit amet " * 40_000


def rows(*texts):
    return [(i, t, "en", "s", len(t or ""), "x", "y", 1, "z", "w") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    data = rows("", None, "one", "the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dog", LONG, "mail me: joe@site.org")
    data += [data[3], (None, "the id is null", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (3, 0, 0), (3, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def real(spark):
    return table(spark, TABLES, "documents")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(TABLES).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, TABLES)
    cols = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    canon = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(canon(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in found.fetchall())


def test_odd_and_empty_tables(spark, odd, none, labels):
    n = odd.count()
    assert mixing.document_rates(odd, labels).count() == n
    assert mixing.resample(odd, labels).columns == odd.columns
    assert toxicity.reject(odd, labels).columns == odd.columns
    assert toxicity.score(odd, labels).count() == n
    assert toxicity.score(odd, labels).filter("doc_id = 1").first()["toxic_score"] is None
    scored = {(r["doc_id"], r["toxic_score"], r["toxic"]) for r in toxicity.score(odd, labels).collect()}
    assert {x for x in scored if x[0] in (0, 1)} == {(0, 0.0, False), (1, None, False)} and len({x for x in scored if x[0] == 3}) == 1
    rates = {r["doc_id"]: (r["n_tokens"], r["rate"]) for r in mixing.document_rates(odd, labels).collect()}
    assert rates[0][0] == rates[1][0] == 0 and rates[5][0] == 200_000 and rates[0][1] == rates[1][1] and min(r for _, r in rates.values()) >= 0
    kept = minhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect() if r[0] is not None) == [0, 1, 2, 3, 3, 5, 6]
    assert minhash.near_duplicates(odd).collect()[0]["doc_ids"] == [3, 4]
    assert pii.redact(odd).filter("doc_id = 6").first()["text"] == "mail me: <EMAIL>"
    assert pii.redact(odd).columns == odd.columns
    assert packing.pack(packing.measured(odd)).count() == n
    assert tokens.prefix_table(odd).count() == n
    assert secrets.scan(odd).count() == 0
    for f in (lambda d: mixing.document_rates(d, labels), lambda d: mixing.resample(d, labels), lambda d: toxicity.score(d, labels), minhash.near_duplicates, minhash.deduplicate, pii.findings, pii.redact, lambda d: packing.pack(packing.measured(d)), tokens.prefix_table, secrets.scan):
        assert f(none).count() == 0


def test_minhash_finds_what_brute_force_finds(real):
    texts = {r["doc_id"]: r["text"] for r in real.select("doc_id", "text").collect()}

    def shingles(t):
        import re

        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    s = {k: shingles(t) for k, t in texts.items()}
    group = {r["doc_id"]: r["group_id"] for r in minhash.membership(real).collect()}
    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if s[a] and s[b]:
                j = len(s[a] & s[b]) / len(s[a] | s[b])
                if j >= 0.7:
                    assert group.get(a, a) == group.get(b, -1), (a, b, j)
    linked = {g: [d for d in group if group[d] == g] for g in set(group.values())}
    for members in linked.values():
        for a in members:
            assert max(len(s[a] & s[b]) / len(s[a] | s[b]) for b in members if b != a) > 0.25


def test_b_bit_similarity_is_corrected():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 1 << 32, (1, 4096), dtype=np.uint32) for _ in range(2))
    mix = np.where(rng.random((1, 4096)) < 0.6, a, b)
    one, two, three = minhash.pack(a), minhash.pack(mix), minhash.pack(b)
    assert abs(minhash.similarity(one, two, cells=4096)[0] - 0.6) < 0.05
    assert abs(minhash.similarity(one, three, cells=4096)[0]) < 0.05


def test_toxicity_agrees_with_labels(spark, real):
    folder = "/root/testdata/sf0.1"  # smaller tables have too few labelled toxic documents a language
    docs, known = table(spark, folder, "documents"), table(spark, folder, "labels")
    train, held = known.filter("doc_id % 2 = 0"), known.filter("doc_id % 2 = 1")
    got = toxicity.score(docs, train).join(held.filter("toxic is not null"), "doc_id").select("doc_id", F.col("toxic_score").alias("p"), held["toxic"].alias("y")).collect()
    toxic = [r["p"] >= 0.5 for r in got if r["y"]]
    clean = [r["p"] >= 0.5 for r in got if not r["y"]]
    assert np.mean(toxic) > 0.88 and np.mean(clean) < 0.02


def test_mixing_reaches_its_targets(spark, real):
    labels = table(spark, TABLES, "labels")
    model = mixing.train_domains(real, labels)
    targets = mixing.default_targets(model.names)
    got = mixing.document_rates(real, labels).collect()
    sums = sum(r["rate"] * r["n_tokens"] * np.array(r["posterior"]) for r in got)
    want = np.array([targets[n] for n in model.names])
    assert min(r["rate"] for r in got) >= 0
    assert np.abs(sums / sum(r["n_tokens"] for r in got) - want).max() < 0.02


def test_boundaries_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x = np.sort(rng.choice(60, 9, replace=False) + 1)
        n = rng.integers(1, 20, 9)

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= v) - v) for v, c in zip(x, n))

        from itertools import combinations

        best = min(padding([*c, x[-1]]) for c in combinations(x[:-1], 2))
        assert padding(packing.boundaries(x, n, 3)) == best


def test_pii_parsers():
    found = lambda t: [(k, t[s:e]) for k, s, e in pii.find(t)]
    assert found("write to ann.lee@mail.example.com.") == [("email", "ann.lee@mail.example.com")]
    assert found("host 10.1.2.3, v1.2.3.4.5, 300.1.1.1") == [("ip", "10.1.2.3")]
    assert found("card 4111 1111 1111 1111 ok") == [("card", "4111 1111 1111 1111")]
    assert found("card 4111 1111 1111 1112") == []
    assert found("SSN: 123-45-6789; 000-12-3456") == [("ssn", "123-45-6789")]
    assert found("ftp://bob:pw@host.example/x") == [("url_login", "bob:pw")]
    assert found("@ @@ a@ @b a@b") == []
    assert pii.redacted(None) is None and pii.redacted("") == ""


def test_forest_on_held_out_findings():
    data = secrets.labelled_findings(2000, 3)
    x = np.array([secrets.features(v, b, a, p, secrets.kind_of(v, b)) for v, b, a, p, _ in data])
    y = np.array([d[4] for d in data])
    half = len(y) // 2
    score = secrets.Forest().fit(x[:half], y[:half]).predict(x[half:])
    assert ((score >= 0.5) == (y[half:] > 0)).mean() > 0.9


def test_tiff_codecs_and_bad_files(spark):
    rng = np.random.default_rng(5)
    for data in (b"", b"a", b"a" * 1000, rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), b"ab" * 900 + b"c" * 300):
        assert tiff.unpackbits(tiff.packbits(data), len(data)) == data
        assert tiff.unlzw(tiff.lzw(data), len(data)) == data
    good = tiff.encode([{"pixels": rng.integers(0, 255, (5, 7)).astype(np.uint8), "compression": 5, "predictor": 2, "rows": 2}])
    loop = bytearray(good)
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk")), (3, None), (4, bytearray()), (None, loop[: len(loop) // 2]), (5, bytearray(b"II" + struct.pack("<HI", 42, 8)))], "key long, data binary")
    got = tiff.pages(df, "key", "data").collect()
    assert [len(r["pixels"]) for r in got if r["key"] == 1] == [35]
    assert all(r["error"] for r in got if r["key"] in (2, 4))
    assert not [r for r in got if r["key"] == 3]


def test_warc_rejects_records_inside_payloads(spark, tmp_path):
    inner = warc.record("resource", "urn:page:99", "http://fake/", b"inside")
    parts = [warc.record("warcinfo", None, None, b"x"), warc.record("resource", "urn:page:1", "http://a/", b"text " + inner + b" more"), warc.record("resource", "urn:page:2", "http://b/", b""), warc.record("resource", "urn:page:3", "http://c/", b"y" * 5000)]
    path = tmp_path / "a.warc"
    path.write_bytes(b"".join(parts))
    (tmp_path / "empty.warc").write_bytes(b"")
    files = spark.createDataFrame([(f"file://{p}", p.stat().st_size) for p in (path, tmp_path / "empty.warc")], "path string, size long")
    for size in (97, 1000, 1 << 20):
        got = warc.records(files, size).orderBy("offset").collect()
        assert [r["record_id"] for r in got if r["type"] == "resource"] == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"], size
        assert bytes(got[1]["payload"]) == b"text " + inner + b" more"


def test_minima_read_a_long_text_whole_behind_any_row():
    words = np.random.default_rng(2).integers(0, 36**3, 200_000)
    long = " ".join(np.base_repr(w, 36).lower() for w in words)
    alone = minhash.minima(pa.array([long]))[0][0]
    for before in (["a short row"], ["one", "", "two words"], ["word " * 16_000]):
        low, count = minhash.minima(pa.array([*before, long, "after it"]))
        assert count[len(before)] == 199_998
        assert (low[len(before)] == alone).all()
        assert (low[-1] == minhash.minima(pa.array(["after it"]))[0][0]).all()


def test_secrets_of_any_name_are_proposed_and_found(spark):
    for name in ("DB_PASSWORD=", "github_token: ", "AWS_SECRET_ACCESS_KEY=", "refresh_token = ", "userPassword: '", "accessToken=", "spring.datasource.password=", '"x-api-key": "', "a" * 80 + "_token_" + "b" * 80 + "="):
        assert [(k, (name + "hunter-xyz")[s:e]) for k, s, e in secrets.candidates(name + "hunter-xyz")] == [("assigned", "hunter-xyz")], name
    assert secrets.candidates("the name: somebody") == []
    positive = [f for f in secrets.labelled_findings(2000, 3) if f[4]]
    docs = spark.createDataFrame([(i, b + v + a, p) for i, (v, b, a, p, _) in enumerate(positive)], "doc_id long, text string, source string")
    for v, b, a, _, _ in positive:
        assert (secrets.kind_of(v, b), len(b), len(b) + len(v)) in secrets.candidates(b + v + a), (b, v, a)
    got = {(r["doc_id"], r["start"], r["end"]) for r in secrets.scan(docs).collect()}
    assert np.mean([(i, len(b), len(b) + len(v)) in got for i, (v, b, _, _, _) in enumerate(positive)]) > 0.95


def test_cards_next_to_other_numbers():
    card = "4111 1111 1111 1111"
    found = lambda t: [t[s:e] for k, s, e in pii.find(t) if k == "card"]
    for text in (f"{card} 12/26", f"{card} 123", f"2 {card}", f"12 {card} 12 26", f"no. 7 {card}-123 x", f"3 17 2024 {card} 5 6 7 8 9 10 11 12 13 14 15 16 17"):
        assert found(text) == [card], text
    assert found("2 4111-1111-1111-1111") == ["4111-1111-1111-1111"]
    assert found("3782 822463 10005 1234") == ["3782 822463 10005"]
    assert found(f"{card} 5500 0000 0000 0004") == [card, "5500 0000 0000 0004"]
    assert found("4111111111111111 5500000000000004") == ["4111111111111111", "5500000000000004"]
    assert found("41 11 11 11 11 11 11 11 12") == [] and found("x4111 1111 1111 1111") == []
    assert pii.redacted(f"pay {card} 12/26") == "pay <CARD> 12/26"


def test_every_cue_announces_its_values():
    found = lambda t: [(k, t[s:e]) for k, s, e in pii.find(t)]
    for value in ("123456789", "123 45 6789", "123-45-6789", "123.45.6789"):
        assert found(f"SSN: {value}.") == found(f"ssn no. {value}, x") == [("ssn", value)]
    assert found("SSN 000456789") == found("SSN 1234567890") == found("SSN: 12 34 56 789") == []
    for value in ("DE89370400440532013000", "de89 3704 0044 0532 0130 00", "DE89-3704-0044-0532-0130-00"):
        assert found(f"IBAN: {value}, x") == [("iban", value)]
    assert found("iban de89370400440532013001") == []
    for value in ("AB123456", "C01X00T47", "AB 123456", "123456789", "ab123456"):
        assert found(f"Passport No. {value}.") == found(f"passport {value}") == [("account", value)]
    assert found("passport control 2024") == found("passport photos2024") == found("passport OFFICE") == []
    for value in ("(555) 123-4567", "(030) 1234567", "555-123-4567"):
        assert found(f"Phone: {value}") == found(f"Tel. {value} x") == found(f"telephone number {value}") == [("phone", value)]
    assert found("phone (see 1234567)") == []


def test_an_email_that_runs_into_prose():
    found = lambda t: [t[s:e] for k, s, e in pii.find(t) if k == "email"]
    assert found("to ann@site.com.2 of them") == ["ann@site.com"]
    assert found("ann@site.com-2024, ann@site.org..x") == ["ann@site.com", "ann@site.org"]
    assert found("write to...ann.lee@mail.example.com.") == ["ann.lee@mail.example.com"]
    assert found("a@b a@b.c1 a.@site.com ..@site.com") == []


def test_tiff_pages_before_and_beside_a_fault_are_read(spark):
    rng = np.random.default_rng(7)
    images = [rng.integers(0, 255, (5, 7)).astype(np.uint8) for _ in range(3)]
    parts = [tiff.encode([{"pixels": x, "rows": 2} for x in images[:n]]) for n in (1, 2, 3)]
    link = len(parts[0]) - 4  # the place of the second directory's offset
    second = struct.unpack_from("<I", parts[2], link)[0]

    def tag_of(data, at, tag):
        return next(q for q in range(at + 2, at + 2 + 12 * struct.unpack_from("<H", data, at)[0], 12) if struct.unpack_from("<H", data, q)[0] == tag)

    def beyond(tag, as_tag):
        data = bytearray(parts[2])
        struct.pack_into("<HHII", data, tag_of(data, second, tag), as_tag, 4, 100, len(data))
        return data

    far = bytearray(parts[2])
    struct.pack_into("<I", far, link, len(far) + 10)
    empty = bytearray(parts[2])
    struct.pack_into("<I", empty, tag_of(empty, second, 257) + 4, 0)
    files = {
        "cut in the third directory": (parts[2][:-20], [0, 1], [2]),
        "cut before the last link": (parts[2][:-4], [0, 1, 2], [3]),
        "second directory beyond the end": (far, [0], [1]),
        "a needed tag beyond the end": (beyond(273, 273), [0, 2], [1]),
        "metadata beyond the end": (beyond(262, 270), [0, 1, 2], []),
        "a tag without values": (empty, [0, 2], [1]),
    }
    df = spark.createDataFrame([(i, bytearray(f[0])) for i, f in enumerate(files.values())], "key long, data binary")
    got = tiff.pages(df, "key", "data").collect()
    for i, (name, (_, good, bad)) in enumerate(files.items()):
        read = {r["page"]: r["pixels"] for r in got if r["key"] == i and not r["error"]}
        assert sorted(read) == good, name
        assert sorted(r["page"] for r in got if r["key"] == i and r["error"]) == bad, name
        assert all(read[n] == images[n].reshape(-1).tolist() for n in good), name


def test_long_secrets_are_whole_runs(spark):
    rng = np.random.default_rng(9)
    run = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), n))
    head, tails = run(200), [run(300), run(300)]
    texts = [f"{cue}{head}{tail}{end}" for cue, end in (("token=", "; x"), ("see ", " x")) for tail in tails]
    for text, start in zip(texts, (6, 6, 4, 4)):
        assert [(s, e) for _, s, e in secrets.candidates(text)] == [(start, start + 500)]
    assert secrets.candidates("x " + "a" * 300 + "1") == [("bare", 2, 303)]
    assert secrets.candidates("x " + "a" * 300) == []
    assert len(secrets.candidates("key=" * 100_000 + "abcdefgh")) == 1
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = secrets.scan(docs, threshold=0.0).collect()
    assert sorted((r["doc_id"], r["end"] - r["start"]) for r in got) == [(i, 500) for i in range(4)]
    assert len({r["fingerprint"] for r in got}) == 2


def test_tiff_pixels_of_grids_of_blocks(spark):
    rng = np.random.default_rng(11)
    whole, real = rng.integers(0, 60_000, (37, 53)), rng.random((37, 53)).astype(np.float32)
    made = [
        {"pixels": whole.astype("<u2"), "compression": code, "predictor": predictor, **blocks}
        for code in (1, 5, 8, 32773)
        for predictor in (1, 2)
        for blocks in ({"tile": 16}, {"rows": 5})
    ]
    made += [{"pixels": real, "compression": 8, "predictor": 3, **blocks} for blocks in ({"tile": 16}, {"rows": 5})]
    df = spark.createDataFrame([(1, bytearray(tiff.encode(made)))], "key long, data binary")
    got = tiff.pages(df, "key", "data").orderBy("page").collect()
    assert len(got) == len(made)
    for r, p in zip(got, made):
        tiled = "tile" in p
        assert (r["error"], r["samples"], r["tiled"], r["blocks"]) == (None, 1, tiled, 12 if tiled else 8)
        assert r["pixels"] == p["pixels"].astype(float).reshape(-1).tolist()


def test_warc_records_of_pages_are_whole(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>héllo\r\n\r\nWARC/1.0</p>"), (2, "http://b/", None), (3, "http://c/", "z" * 70_000)], "page_id long, url string, html string")
    got = warc.records(warc.write(pages, warc.folder_of(spark, "warc-test"))).collect()
    found = {r["record_id"]: (r["uri"], bytes(r["payload"]).decode()) for r in got if r["type"] == "resource"}
    assert found == {f"<urn:page:{r['page_id']}>": (r["url"], r["html"] or "") for r in pages.collect()}
    assert all(r["date"] and r["offset"] >= 0 for r in got)
