import importlib.util
import re
from collections import Counter

import corpus_pipeline


def test_stages_keep_what_they_should(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "123 456", "en", "s", 7), (9003, "", "en", "s", 0)], docs.schema)
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    leak = spark.createDataFrame([(9004, f"Some words before it. {item} And some after.", "en", "s", 1)], docs.schema)
    now = docs.unionByName(extra).unionByName(leak).repartition(4)
    sizes = [now.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == docs.columns
        sizes.append(now.count())
        ids = {r.doc_id for r in now.select("doc_id").collect()}
        if name == "language_id":
            assert not ids & {9001, 9002, 9003} and 9004 in ids
        if name == "decontamination":
            assert 9004 not in ids
        if name == "exact_dedup":
            assert now.select("text").distinct().count() == sizes[-1]
    assert sizes == sorted(sizes, reverse=True)
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, folder)
    assert pieces.select("doc_id").distinct().count() == sizes[-1]


def test_stages_on_odd_rows(spark, docs, odd):
    """Nulls, ties, repeated ids and rows, clashing columns and empty tables, stage by stage."""
    folder = "/root/testdata/sf0.001"
    clash = "1 AS __gone", "2 AS __n", "'a' AS KEPT", "'b' AS score", "'c' AS lang_pred", "4 AS component", "5 AS key", "6 AS sequence_id"
    full = docs([*odd, (7, "unlike but of one id"), (None, "another without an id")]).selectExpr("*", *clash)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, full, folder)
        ids = [r.doc_id for r in got.collect()]
        if name == "packing":
            assert set(ids) == {r.doc_id for r in full.collect()}
        else:
            assert got.columns == full.columns
            texts = Counter(r.text or "" for r in got.collect())
            assert texts["unlike but of one id"] == texts["another without an id"] == 1
            if name in ("exact_dedup", "near_dedup"):
                assert texts["tie tie tie"] == 1
        assert stage(spark, full.where("false"), folder).count() == 0


def test_every_operator_is_registered():
    assert importlib.util.find_spec("lodestrand.llm") is not None
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {m[0] for n in names if (m := re.match(r"op\d+", n))} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names


def test_run_equals_brute_force(spark, tmp_path):
    """The whole run over a table with exact, near and leaking documents, stage by stage in plain code, to the pieces' ids."""
    import zlib

    import numpy as np
    import public_tokenizers
    from pyspark.sql import functions as F
    from test_dedup import brute_components
    from test_models import plain_matches
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(F.length("text") < 4_000)
    rows = [tuple(r) for r in docs.collect()]
    more = [(10_000 + i, t, "en", "s", len(t)) for i, t in enumerate([rows[0][1], rows[3][1] + " one more word", f"Before it. {items[0][1]} After it.", "12 34", " ".join(items[1][1].split()[: len(items[1][1].split()) // 2]) + " and so on"])]
    more += [(20_000, None, "en", "s", None), (20_001, "", None, "s", 0)]
    rows += more
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "in" / "benchmark.parquet"))

    kept = [(r[0], r[1]) for r in rows if any(ch.isalpha() for ch in r[1] or "")]
    last = {}
    for d, t in kept:
        last[t] = max(last.get(t, -1), d)
    kept = [(d, t) for d, t in kept if last[t] == d]
    kept = [(d, t) for d, t in kept if (d, d) in {(x[0], x[2]) for x in brute_components(kept, 5, 80)}]
    leaks = {d for d, _ in plain_matches(kept, items)}
    kept = [(d, t) for d, t in kept if d not in leaks]
    assert leaks and len(kept) < len(rows) - 10

    pieces = {}
    for p in corpus_pipeline.run(spark, str(tmp_path / "in")).collect():
        pieces.setdefault(p.doc_id, []).append(p)
    assert pieces.keys() == {d for d, _ in kept}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, t in kept:
        ids, at = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
        for p in sorted(pieces[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
