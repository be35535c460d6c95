"""Stored indexes and segment logs: batches rank as a rebuild, versions are whole or not there."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import bm25, segments
from lodestrand.sources import versions

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


@pytest.fixture
def made(spark):
    r = random.Random(4)

    def make(ids):
        return spark.createDataFrame([(i, f"o{i % 4}", " ".join(r.choice(WORDS) for _ in range(r.randrange(9)))) for i in ids], "doc_id long, source string, text string")

    return make


def terms(spark):
    return spark.createDataFrame([(q, 1, w) for q, ws in enumerate((WORDS[:2], WORDS[3:6], ["theta", "none"])) for w in ws], "query_id int, set_id int, term string")


@pytest.mark.parametrize("fan", [2, 3, 10])
def test_batches_rank_as_a_rebuild(spark, made, tmp_path, fan):
    r = random.Random(fan)
    log, now = segments.LexicalLog(spark, str(tmp_path / "log"), owner="source", fan=fan), {}
    for step in range(6):
        ids = r.sample(range(40), 12 if step else 30)
        if step == 2:
            log.delete(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
            now = {i: x for i, x in now.items() if i not in ids}
            continue
        batch = made(ids)
        rows = {x.doc_id: tuple(x) for x in batch.collect()}
        if step == 4:
            batch = spark.createDataFrame(list(rows.values()), batch.schema)
            log.upsert(batch, purge=spark.createDataFrame([("o1",)], "owner string"))
            now = {i: x for i, x in now.items() if x[1] != "o1"} | rows
        else:
            log.upsert(spark.createDataFrame(list(rows.values()), batch.schema))
            now |= rows
        rebuilt = bm25.Index.of(spark.createDataFrame(list(now.values()), batch.schema))
        want = sorted(map(tuple, bm25.bm25(rebuilt, terms(spark)).collect()))
        assert sorted(map(tuple, bm25.bm25(log.index(), terms(spark)).collect())) == want
    segments_now = log.log.state()[1]["segments"]
    assert len(segments_now) < 6 or fan > 6
    before = {x.doc_id for x in log.log.rows("lengths").collect()}
    log.log.spark, gone = spark, versions.vacuum(spark, log.log.path)
    assert (len(gone) > 0) == (fan < 6) and {x.doc_id for x in log.log.rows("lengths").collect()} == before == set(now)


def test_a_batch_writes_its_own_rows(spark, made, tmp_path):
    log = segments.LexicalLog(spark, str(tmp_path / "log"), fan=100)
    log.upsert(made(range(500)))
    log.upsert(made([3, 4]))
    folder = log.log.state()[1]["segments"][-1]["folder"]
    part = lambda t: spark.read.parquet(f"{tmp_path}/log/{folder}/{t}")
    assert {x.doc_id for x in part("lengths").collect()} == {3, 4} == {x.doc_id for x in part("__gone").collect()}
    assert {x.doc_id for x in part("postings").collect()} <= {3, 4}


def test_a_killed_write_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = segments.DocumentStore(spark, str(tmp_path / "store"), ("documents", "pages"))
    d = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, v string")
    p = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (9, 1)], "doc_id long, page int")
    store.persist({"documents": d, "pages": p})
    first = store.version()
    whole = segments.SegmentLog._write

    def dies(self, folder, table, rows):
        if table == "pages":
            raise RuntimeError("killed")
        return whole(self, folder, table, rows)

    monkeypatch.setattr(segments.SegmentLog, "_write", dies)
    with pytest.raises(RuntimeError):
        store.persist({"documents": d.withColumn("v", F.lit("new")), "pages": p})
    monkeypatch.undo()
    seen = lambda t: sorted(map(tuple, store.rows(t).where("doc_id IS NOT NULL").collect()))
    assert store.version() == first and seen("documents") == [(1, "a"), (2, "b")] and seen("pages") == [(1, 1), (1, 2), (2, 1)]
    assert len(store.vacuum()) == 1
    assert {x["table"]: x.deleted for x in store.delete(spark.createDataFrame([(1,)], "doc_id long")).collect()} == {"documents": 1, "pages": 2}
    assert seen("documents") == [(2, "b")] and seen("pages") == [(2, 1)]
    store.restore(first)
    assert seen("documents") == [(1, "a"), (2, "b")] and seen("pages") == [(1, 1), (1, 2), (2, 1)]
    store.persist({"documents": d.where("doc_id = 1").withColumn("v", F.lit("again")), "pages": p.where("page = 2")})
    assert seen("documents") == [(1, "again"), (2, "b")] and seen("pages") == [(1, 2), (2, 1)]


def test_two_writers_cannot_make_one_version(spark, tmp_path):
    path = str(tmp_path / "v")
    assert versions.current(spark, path) == (0, {})
    versions.publish(spark, path, 0, {"folders": ["a"]})
    with pytest.raises(versions.Conflict):
        versions.publish(spark, path, 0, {"folders": ["b"]})
    assert versions.current(spark, path) == (1, {"folders": ["a"]}) and versions.versions(spark, path) == [1]


def test_filtered_frames_have_indexes_of_their_own(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few, n = docs.where("lang = 'en'"), lambda i: i.stats.first().n_docs
    assert n(bm25.Index.stored(few)) == few.count() < docs.count() == n(bm25.Index.stored(docs))
    assert n(bm25.Index.stored(docs.where("lang = 'de'"))) == docs.where("lang = 'de'").count()
    assert bm25.Index.stored(docs).postings.inputFiles() == bm25.Index.stored(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).postings.inputFiles()
    assert n(bm25.Index.stored(docs.withColumn("text", F.lit("one")))) == docs.count()
    assert n(bm25.Index.stored(spark.createDataFrame([(1, "s", "x")], "doc_id long, source string, text string"))) == 1


def test_vectors_by_batches(spark, tmp_path):
    log = segments.VectorLog(spark, str(tmp_path / "v"), fan=2)
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, owner string, embedding array<double>, meta map<string,string>")
    log.upsert(frame([(1, "a", [1.0], {"k": None, "j": "x"}), (2, "a", [2.0], {}), (3, "b", [3.0], None), (None, "b", [0.0], None)]), metadata="meta")
    log.upsert(frame([(2, "a", [9.0], None)]), purge=True, metadata="meta")
    log.delete(spark.createDataFrame([(7,)], "vec_id long"))
    assert sorted((r.vec_id, r.embedding, r.meta) for r in log.rows().collect()) == [(2, [9.0], None), (3, [3.0], None)]
