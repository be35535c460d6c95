"""Queries over whole texts against plain code."""

import re
from collections import Counter

import pytest

from lodestrand.functions import text as tx
from lodestrand.plans.registry import QUERIES
from lodestrand.plans import texts

TEXTS = [
    "1.2 Intro\nsee fig. 3 and\n\nTable 4.1, token = abc99 and sk-real77 too\r\nIV. More of eq. (2)",
    None,
    "",
    "Authorization: Bearer real123.x then api_key='zz9' t4 t4 k4\nXII.3 Deep\n7\nSection IX and figure 2",
    "t4 is no secret here, k4 neither",
    "plain",
]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([*enumerate(TEXTS), (9, TEXTS[3])], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def rows():
    return [*enumerate(TEXTS), (9, TEXTS[3])]


def redacted(s):
    for pattern, by in tx.REDACTIONS:
        s = re.sub(pattern, re.sub(r"\$(\d)", r"\\g<\1>", by), s, flags=re.A)
    return s


def made(i):
    return f"See Fig. {i % 12} and Table {i % 5 + 1}.{i % 3}, eq. ({i % 9}) in Section IV; also figure {i % 12 + 1}."


def test_redaction_of_whole_texts(spark, folder):
    got = {r.doc_id: (r.redacted, r.leaks) for r in QUERIES["redact_documents"](spark, folder).collect()}
    assert got == {i: (redacted((t or "") + "\n" + texts.SHAPES[i % 5].replace("{n}", str(i))), False) for i, t in rows()}
    assert not any(x in s for s, _ in got.values() for x in ("abc99", "real77", "real123"))


def test_a_leak_is_seen(spark, folder, monkeypatch):
    monkeypatch.setattr(tx, "REDACTIONS", ())
    assert all(r.leaks for r in QUERIES["redact_documents"](spark, folder).collect())


def test_references_of_whole_texts(spark, folder):
    got = [(r.doc_id, r.pos, r.text) for r in QUERIES["document_refs"](spark, folder).collect()]
    want = [(i, k, x) for i, t in rows() for k, x in enumerate(re.findall(tx.CROSS_REFERENCE_PATTERN, (t or "") + "\n" + made(i)))]
    assert sorted(got) == sorted(want)
    resolved = QUERIES["resolve_document_refs"](spark, folder).collect()
    assert Counter(r.source for r in resolved) == Counter(i for i, *_ in want)
    assert ("figure", "Figure 3") in {(r.type, r.label) for r in resolved if r.source == 0}


def test_headings_of_all_lines(spark, folder):
    got = {(r.doc_id, r.line_no): (r.heading, r.depth) for r in QUERIES["document_headings"](spark, folder).collect()}
    assert all(len([k for k in got if k[0] == i]) == len(re.split(r"\r?\n", t or "")) + 1 for i, t in rows())
    for line, depth in got.values():
        m = re.match(r"([0-9]+|[IVXLCDM]+)((?:\.[0-9]+)*)\.?\s+\S", " ".join(line.split()))
        assert depth == (None if m is None else m[2].count(".") + 1)
    assert got[0, 1] == ("1.2 Intro", 2) and got[3, 2] == ("XII.3 Deep", 2)
