import random

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import contracts as ct
from lodestrand.functions import numeric as nm
from lodestrand.functions import text as tx
from lodestrand.functions.stemming import mixed_tokens, stem
from lodestrand.operators.chunking import block_chunks, char_chunks, split_prose
from lodestrand.sources.readers import html_tables


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_words_terms_and_sentences(spark):
    assert one(spark, "k-means GPT4 3.14 ß x_y The", tx.word_tokens) == ["k-means", "gpt", "4", "3.14", "x_y", "the"]
    assert one(spark, None, tx.word_tokens) == []
    assert one(spark, "a b a c d e f g h i j", tx.query_terms) == list("abcdefgh")
    assert one(spark, "One. Two! 三。rest", tx.sentences) == ["One.", "Two!", "三。", "rest"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Authorization: Bearer abc.def", "Authorization: Bearer ***"),
        ("token=xyz, ok", "token=***, ok"),
        ('"api_key": "v1"', '"api_key":"***"'),
        ("use sk-Ab1_c now", "use sk-*** now"),
        ("risk-free", "risk-free"),
        ("authorization: plain", "authorization: ***"),
    ],
)
def test_redaction(spark, text, want):
    assert one(spark, text, tx.redact) == want


def test_headings_references_and_margins(spark):
    depth = lambda s: one(spark, s, tx.heading_depth)
    assert [depth(s) for s in ("1 Intro", "1.2.3 Deep", "IV Results", "II.1 Sub", "Plain", None)] == [1, 3, 1, 2, None, None]
    refs = one(spark, "see Fig. 3 and Table (2.1); eq. 4.", tx.cross_references)
    assert [(r.type, r.label) for r in refs] == [("figure", "Figure 3"), ("table", "Table 2.1"), ("equation", "Eq. 4")]
    assert one(spark, " 12 ", tx.margin_text) == "<page-number>"
    assert one(spark, "a k-\nmeans para-\ngraph\nnext", tx.join_lines) == "a k-means paragraph next"


def test_operations_and_intents(spark):
    assert one(spark, "How  many papers are there", tx.operation) == "count"
    assert one(spark, "what is this", tx.operation) == "document_status"
    assert one(spark, "Hi. Please remember my name", tx.has_memory_intent) is True
    assert one(spark, "I remember it", tx.has_memory_intent) is False


def test_router_faults(spark):
    cases = {"": "empty_output", "{": "invalid_json", "[1]": "not_json_object", '{"a":1}': "missing_intent", '{"intent":"simple_rag","b":1}': "extra_fields", '{"intent":"x"}': "invalid_intent", '{"intent":"simple_rag"}': None}
    for raw, want in cases.items():
        assert one(spark, raw, ct.router_fault) == want, raw
        assert one(spark, raw, ct.router_intent) == ("simple_rag" if want is None else "agentic_rag")
    assert one(spark, None, ct.router_fault) == "empty_output"


def test_numbers(spark):
    assert one(spark, 800.0, nm.sigmoid, "double") == 1.0 and one(spark, -800.0, nm.sigmoid, "double") == 0.0
    row = spark.sql("SELECT array(0.0, 0.0) AS z, array(1.0, 2.0) AS a").select(nm.cosine(F.col("z"), F.col("a")).alias("c"), nm.cosine(F.col("a"), F.col("a")).alias("d")).first()
    assert row.c == 0.0 and abs(row.d - 1) < 1e-12
    now = F.lit("2026-01-01").cast("timestamp")
    got = spark.sql("SELECT timestamp'2025-10-03' AS a, timestamp'2027-01-01' AS b").select(nm.recency(F.col("a"), now).alias("x"), nm.recency(F.col("b"), now).alias("y")).first()
    assert abs(got.x - 0.5) < 1e-9 and got.y == 1.0


def test_stems():
    pairs = "caresses caress ponies poni ties tie cats cat agreed agre plastered plaster motoring motor sing sing hopping hop hoping hope relational relat conditional condit generalization general running run happily happili national nation".split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]
    assert mixed_tokens("Running 深度学习 running ＡＢ") == ["running", "run", "ab", "深度", "度学", "学习"]


def test_char_chunks_bound_and_cover():
    r = random.Random(1)
    for _ in range(50):
        text = " ".join("w" * r.randint(1, 30) + r.choice(["", ".", "!"]) for _ in range(r.randint(0, 200)))
        chunks = char_chunks(text, 120, 30)
        assert all(0 < len(c) <= 120 for c in chunks)
        assert all(any(s in c for c in chunks) for s in text.split())
    assert char_chunks("x" * 2000, 900, 120) == ["x" * 900, "x" * 900, "x" * 440]
    assert char_chunks(None) == [] and char_chunks("  ") == []


def test_block_chunks_stay_in_sections():
    blocks = [("a", "one two three. " * 50), ("a", "four five. " * 60), ("b", "six " * 900)]
    out = block_chunks(blocks)
    assert [s for s, _ in out] == sorted(s for s, _ in out)
    assert max(len(c.split()) for _, c in out) <= 800
    assert split_prose("See. Fig. 3 is e.g. here. Done") == ["See.", "Fig. 3 is e.g.", "here.", "Done"]


def test_html_tables_expand_spans():
    html = "<table><tr><th>a<th>a<th colspan=2>b</tr><tr><td rowspan=2>1<td>2<td>3<td>4</tr><tr><td>5<td>6<td>7</tr><tr><td> </td></tr></table>"
    assert html_tables(html) == [(["a", "a_2", "b", "b_2"], [["1", "2", "3", "4"], ["1", "5", "6", "7"]])]
    assert html_tables(None) == [] and html_tables("<table></table>") == []
