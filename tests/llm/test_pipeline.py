"""The pipeline as a whole: each stage against a plain version on its own input, and odd documents through all of it."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from scorelake.llm import minhash, mixing, packing, pii, toxicity
from scorelake.llm._common import staged, table

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs, out = table(spark, TABLES, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = staged(stage(spark, docs, TABLES), name)
        out[name] = (docs, made)
        docs = made
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_toxic_documents_go_and_the_others_stay_as_they_were(spark, stages):
    before, after = stages["toxicity"]
    flagged = {r["doc_id"] for r in toxicity.score(before, table(spark, TABLES, "labels")).filter("toxic").collect()}
    assert sorted(rows(after)) == sorted(r for r in rows(before) if r[0] not in flagged)
    labelled = {r["doc_id"]: r["toxic"] for r in table(spark, TABLES, "labels").collect()}
    clean = [r[0] for r in rows(before) if labelled.get(r[0]) == 0]
    assert np.mean([d not in flagged for d in clean]) > 0.95


def test_one_document_of_each_group_stays(stages):
    before, after = stages["minhash"]
    group = {r["doc_id"]: r["group_id"] for r in minhash.membership(before).collect()}
    assert sorted(rows(after)) == sorted(r for r in rows(before) if group.get(r[0], r[0]) == r[0])
    texts = Counter(re.sub(r"\W+", " ", r[1].lower()).strip() for r in rows(after))
    assert max(texts.values()) == 1  # no exact copies are left


def test_personal_data_is_replaced(stages):
    before, after = stages["pii"]
    want = [(r[0], pii.redacted(r[1]), *r[2:4], len(pii.redacted(r[1])) if pii.find(r[1]) else r[4]) for r in rows(before)]
    assert sorted(rows(after)) == sorted(want)


def test_documents_come_as_often_as_their_rates_say(spark, stages):
    before, after = stages["mixing"]
    rate = {r["doc_id"]: r["rate"] for r in mixing.document_rates(before, table(spark, TABLES, "labels")).collect()}
    times = Counter(rows(after))
    whole = {r[0]: r for r in rows(before)}
    assert set(times) <= set(whole.values())
    for d, x in rate.items():
        assert int(x) <= times[whole[d]] <= int(x) + 1
    assert abs(sum(times.values()) - sum(rate.values())) < 4 * len(rate) ** 0.5


def test_batches_are_those_of_a_plain_packing(stages):
    before, after = stages["packing"]
    items = sorted((max(1, len(re.findall(r"\S+", r[1]))), r[0]) for r in rows(before))
    lengths, counts = np.unique([n for n, _ in items], return_counts=True)
    want, bounds = [], packing.boundaries(lengths, counts)
    for low, high in zip([0, *bounds], bounds):
        inside = [x for x in items if low < x[0] <= high]
        room = max(1, packing.BUDGET // high)
        want += [(d, n, high, i // room, i % room) for i, (n, d) in enumerate(inside)]
    assert sorted(rows(after)) == sorted(want)


def test_run_is_all_stages(spark, stages):
    assert sorted(rows(corpus_pipeline.run(spark, TABLES))) == sorted(rows(stages["packing"][1]))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __gone string, rate double, __copy int, n_tokens string, node string, part int"
LABELS = "doc_id long, quality int, toxic int"


def written(spark, folder, docs, labels):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_documents_pass_through(spark, tmp_path):
    fill = ("x", 0.5, 3, "n", "m", 4)
    docs = [(0, "", "en", "s", 0, *fill), (1, None, None, None, None, *fill), (2, "word " * 200_000, "en", "s", 1_000_000, *fill), (3, "the same words twice over here", "de", "s", 30, *fill), (4, "the same words twice over here", "de", "s", 30, *fill), (None, "an id is missing: joe@site.org", None, None, 30, *fill), (5, "!!! ... ???", "fr", "s", 11, *fill)]
    docs += [docs[3], docs[0]]
    folder = written(spark, tmp_path / "odd", docs, [(3, 1, 0), (3, 1, None), (None, 1, 1), (2, None, 0), (99, 0, 1)])
    frame = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = staged(stage(spark, frame, folder), name)
        assert frame.columns == table(spark, folder, "documents").columns and frame.schema == table(spark, folder, "documents").schema, name
    ids = {r["doc_id"] for r in frame.collect()}
    assert {0, 1, 2, 3, None, 5} >= ids and 4 not in ids
    assert all("@" not in (r["text"] or "") for r in frame.collect())
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "bucket_len", "batch", "slot"] and got.count() == frame.count()


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "none", [], [])).count() == 0
    one = written(spark, tmp_path / "one", [(7, "a single document", "en", "s", 17, "", 0.0, 0, "", "", 0)], [])
    assert [r["doc_id"] for r in corpus_pipeline.run(spark, one).collect()] == [7]
