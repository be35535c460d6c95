import json

import pytest
from pyspark.sql import functions as F

from lodestrand.sources import readers, writers
from lodestrand.streaming import events as sv

CASE = {"id": "router-a", "input": {"session_context": [], "current_question": "q"}, "expected": {"intent": "simple_rag"}, "metadata": {"language": "en"}}


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_case_scans(spark, tmp_path):
    good = lines(tmp_path / "a.jsonl", CASE, CASE | {"id": "router-b", "metadata": {}})
    assert readers.strict_cases(spark, good).count() == 2
    assert {x.language for x in readers.lenient_cases(spark, good).collect()} == {"en", "unknown"}
    with pytest.raises(ValueError):
        readers.strict_cases(spark, lines(tmp_path / "b.jsonl", CASE, CASE))
    broken = lines(tmp_path / "c.jsonl", CASE, "{not json")
    assert readers.lenient_cases(spark, broken).count() == 1
    with pytest.raises(Exception):
        readers.strict_cases(spark, broken)
    assert readers.case_ids(spark, lines(tmp_path / "ids", "a", "", "b")).count() == 2
    for rows in (("a", "a"), ("", "")):
        with pytest.raises(ValueError):
            readers.case_ids(spark, lines(tmp_path / f"ids{len(rows[0])}", *rows))


def test_names_and_uploads(spark):
    d = spark.createDataFrame([("up/My paper (1).PDF", bytearray(b"%PDF-1.7 x")), ("../..", bytearray(b"GIF"))], "n string, c binary")
    got = d.select(readers.safe_name(F.col("n")).alias("s"), readers.title_of(F.col("n")).alias("t"), readers.is_pdf(F.col("n"), F.col("c")).alias("p")).collect()
    assert [(x.s, x.p) for x in got] == [("My_paper_1_.PDF", True), ("document", False)]
    assert got[0].t == "My paper (1)"


def test_replacing_documents_touches_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "store")
    d = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "id int, v string, bucket int")
    writers.replace_documents(d, path)
    writers.replace_documents(spark.createDataFrame([(3, "c", 1)], "id int, v string, bucket int"), path)
    assert {(x.id, x.bucket) for x in spark.read.parquet(path).collect()} == {(1, 0), (3, 1)}


def test_resume_retries_errors_only(spark, tmp_path):
    cases = spark.createDataFrame([("a", "s"), ("b", "s")], "case_id string, signature string")
    path = str(tmp_path / "runs")
    writers.resume(cases, path, lambda c: c.withColumn("error", F.when(F.col("case_id") == "b", "x")))
    out = writers.resume(cases, path, lambda c: c.withColumn("error", F.lit(None).cast("string")))
    assert sorted((x.case_id, x.error) for x in out.collect() if x.case_id == "a") == [("a", None)]
    assert out.count() == 3 and writers.pending_cases(cases, out).count() == 0


def test_longest_prefix_claims_first(spark):
    p = spark.createDataFrame([("k1", "paper"), ("k2", "paper-two"), ("k3", "none")], "key string, prefix string")
    f = spark.createDataFrame([("paper-one.pdf",), ("paper-two.pdf",)], "name string")
    assert {(x.key, x.name) for x in writers.prefix_claims(p, f).collect()} == {("k1", "paper-one.pdf"), ("k2", "paper-two.pdf")}


def test_breaker_opens_and_closes():
    rows = [(0, True), (1, True), (2, True), (3, False), (40, False), (41, True)]
    out, state = sv.breaker_steps([(float(t), f) for t, f in rows], ([], 0.0, False), 3, 60.0, 30.0)
    assert out == ["failed", "failed", "opened", "rejected", "closed", "failed"]
    again, _ = sv.breaker_steps([(42.0, True), (43.0, True)], state, 3, 60.0, 30.0)
    assert again == ["failed", "opened"]


def test_keyed_upsert_is_idempotent(spark, tmp_path):
    put = sv.keyed_upsert(str(tmp_path / "kv"))
    a = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "id int, version int, v string")
    b = spark.createDataFrame([(1, 2, "z")], "id int, version int, v string")
    put(a, 0)
    for _ in range(2):  # a replayed batch changes nothing
        put(b, 1)
        assert {(x.id, x.v) for x in sv.upserted(spark, str(tmp_path / "kv"), ["id", "version", "v"]).collect()} == {(1, "z"), (2, "y")}
    # Only the bucket of the key that changed was written again.
    assert len([x for x in (tmp_path / "kv/batch=1").iterdir() if x.name.startswith("bucket=")]) == 1


def test_stream_equals_batch(spark):
    folder = "/root/testdata/sf0.001"
    e = sv.read_stream(spark, f"{folder}/events.parquet")
    out = sv.run_available(sv.progress(e, ("error",)).select("event_id"))
    batch = spark.read.parquet(f"{folder}/events.parquet").where("event_type = 'error'").select("event_id")
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0


def test_sqlite_table_is_read_in_ranges(spark, tmp_path):
    import sqlite3

    from lodestrand.sources import files

    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE chunks (id INTEGER PRIMARY KEY, content TEXT, score REAL)")
        db.executemany("INSERT INTO chunks VALUES (?, ?, ?)", [(i, None if i % 7 == 0 else f"t{i}", i / 2) for i in range(5, 260)])
        db.execute("CREATE TABLE none (id INTEGER PRIMARY KEY)")
    schema = "id long, content string, score double"
    got = files.sqlite_table(spark, path, "chunks", schema, rows_per_task=50)
    assert got.rdd.getNumPartitions() == 6
    assert sorted((x.id, x.content or "", x.score) for x in got.collect()) == [(i, "" if i % 7 == 0 else f"t{i}", i / 2) for i in range(5, 260)]
    assert files.sqlite_table(spark, path, "none", "id long").count() == 0
    try:
        files.sqlite_table(spark, path, "a; DROP", schema)
        raise AssertionError
    except ValueError:
        pass


def test_manifests_skip_malformed_files(spark, tmp_path):
    from lodestrand.sources import files

    for i, text in enumerate(['{"a": 1, "b": "x"}', "{broken", '{"a": 2}']):
        (tmp_path / f"m{i}.json").write_text(text)
    got = files.manifests(spark, str(tmp_path / "m*.json"), "a int, b string")
    assert sorted((x.a, x.b or "") for x in got.collect()) == [(1, "x"), (2, "")]


def test_settings_keep_their_invariants():
    from lodestrand.operators.service import settings_faults

    assert settings_faults({}) == []
    assert settings_faults({"semantic_weight": 0.9, "pack_tokens": 30_000, "read_seconds": 500}) == ["weights", "pack_budget", "timeouts"]
