"""Chunks by model tokens against a plain counter that tries every length in turn."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
from lodestrand.functions import tokens
from lodestrand.operators import token_chunks as tc
from lodestrand.operators.chunking import split_prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_section(texts, sizes, count):
    """The rule read word for word: one more sentence or word at a time, every count anew."""
    out, now, held, only = [], [], 0, False
    for i, text in enumerate(texts):
        n = count(text)
        if n > sizes.most:
            if now:
                out.append(now)
            now, held = [], 0
            sentences, words, at = split_prose(text), text.split(), 0
            if len(sentences) > 1:
                while at < len(sentences):
                    end = at + 1
                    while end < len(sentences) and count(" ".join(sentences[at : end + 1])) <= sizes.most:
                        end += 1
                    out.append([(i, " ".join(sentences[at:end]))])
                    if end >= len(sentences):
                        break
                    limit, total, k = max(1, int(sizes.most * sizes.overlap)), 0, 0
                    for s in sentences[at:end][::-1]:
                        if k and total + count(s) > limit:
                            break
                        total, k = total + count(s), k + 1
                    at = max(end - k, at + 1)
                continue
            while at < len(words):
                end = at + 1
                while end < len(words) and count(" ".join(words[at : end + 1])) <= sizes.most:
                    end += 1
                if end < len(words):
                    stops = [j for j in range(at, end) if words[j][-1] in ".!?"]
                    if stops and stops[-1] > at + sizes.least // 2:
                        end = stops[-1] + 1
                out.append([(i, " ".join(words[at:end]))])
                if end >= len(words):
                    break
                at = max(end - max(1, int((end - at) * sizes.overlap)), at + 1)
            continue
        if now and held + n > sizes.target:
            out.append(now)
            sentences, total, kept = split_prose(now[-1][1]), 0, []
            for s in sentences[::-1] if sizes.overlap else []:
                if kept and total + count(s) > max(1, int(sizes.target * sizes.overlap)):
                    break
                kept.insert(0, s)
                total += count(s)
            now = [(now[-1][0], " ".join(kept))] if kept else []
            held, only = sum(count(x) for _, x in now), bool(now)
        if only and held + n > sizes.most:
            now, held = [], 0
        now.append((i, text))
        held, only = held + n, False
    return out + ([now] if now else [])


def test_sections_equal_the_plain_fold():
    r = random.Random(3)
    library = Tokenizer.from_file(PATH)
    vocabulary = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    words = ["a", "internationalisation", "graph", "e.g.", "end.", "(x)", "étude", "why?", "日本語"]
    for sizes in (tc.Sizes(20, 5, 40, 0.2), tc.Sizes(12, 4, 15, 0.0), tc.Sizes(50, 30, 60, 0.4)):
        for _ in range(40):
            texts = [" ".join(r.choice(words) for _ in range(r.choice([1, 5, 30, 150]))) for _ in range(r.randrange(1, 9))]
            for count in (vocabulary, tokens.counter(None)):
                assert tc.section_chunks(texts, sizes, count) == plain_section(texts, sizes, count)


def test_counter_equals_the_library():
    library = Tokenizer.from_file(PATH)
    count = tokens.counter(PATH)
    for t in ("", "a b", "x" * 5000, "naïve  日本 <|endoftext|>"):
        assert count(t) == len(library.encode(t, add_special_tokens=False).ids)
    assert tokens.counter(None)(" a  b ") == 2


def test_chunks_keep_where_they_came_from(spark):
    rows = [
        (1, 0, "u0", "paragraph", "s1", "Intro", None, 1, "First one. Second\none.", 0.0, 0.0, 10.0, 10.0), (1, 1, "u1", "paragraph", "s1", "Intro", None, 2, "Third here.", 5.0, 5.0, 20.0, 9.0),
        (1, 2, "u2", "reference", "s1", "Intro", None, 2, "[1] A.", 0.0, 50.0, 9.0, 60.0), (1, 3, "u3", "reference", "s1", "Intro", None, 2, "[2] B.", None, None, None, None),
        (1, 4, "u4", "table", "s1", "Intro", None, 2, "not prose", 0.0, 0.0, 1.0, 1.0), (1, 5, "u5", "list", "s2", "Rest", "Sub", None, "Item.", 0.0, 0.0, 1.0, 1.0),
        (1, 6, "u6", "paragraph", "s2", "Rest", "Sub", 3, "taken by an equation", 0.0, 0.0, 1.0, 1.0), (2, 0, "v0", "abstract", None, None, None, None, "Alone.", None, None, None, None), (3, 0, "w0", "paragraph", None, None, None, 1, "  ", None, None, None, None),
    ]
    b = spark.createDataFrame([(*r, f"T{r[0]}") for r in rows], "doc_id long, ord long, uid string, kind string, section_uid string, section string, subsection string, page long, text string, x0 double, y0 double, x1 double, y1 double, name string")
    drop = spark.createDataFrame([(1, "u6")], "doc_id long, uid string")
    got = {(r.doc_id, r.chunk_uid): r for r in tc.chunk_by_tokens(b, None, tc.Sizes(10, 2, 20, 0.1), "name", drop).collect()}
    assert got.keys() == {(1, "text-1-0"), (1, "text-2-0"), (1, "text-3-0"), (1, "text-4-0"), (2, "text-1-0")}
    first = got[1, "text-1-0"]
    assert (first.content, first.tokens, first.block_uids, first.page_start, first.page_end) == ("First one. Second one.\n\nThird here.", 6, ["u0", "u1"], 1, 2)
    assert first.page_boxes == {1: [0.0, 0.0, 10.0, 10.0], 2: [5.0, 5.0, 20.0, 9.0]} and first.embedding_text == "T1\nIntro\nFirst one. Second one.\n\nThird here."
    assert got[1, "text-3-0"].page_boxes == {} and got[1, "text-4-0"].page_start is None and got[1, "text-4-0"].embedding_text == "T1\nRest\nSub\nItem." and got[2, "text-1-0"].embedding_text == "T2\nAlone."


def test_query_bounds_are_of_the_vocabulary(spark):
    got = entry.queries()["token_chunks"](spark, "/root/testdata/sf0.001").collect()
    library = Tokenizer.from_file(PATH)
    assert len(got) > 200
    for r in got:
        n = len(library.encode(r.content, add_special_tokens=False).ids)
        assert r.tokens == n and (n <= 130 or len(split_prose(r.content)) == 1)  # a sentence is not cut


def test_pieces_have_the_counts_of_whole_texts():
    """a counter encoded every text anew, word for word, for each length that it tried."""
    library = Tokenizer.from_file(PATH)
    tokens.counter.cache_clear()
    count, r = tokens.counter(PATH), random.Random(5)
    parts = [*"ab'sd1. \n\t-\x1c\x85\xa0᠎ ​　é日İ\U0001f600", "  ", "\r\n", " \n", "'ll", "'re", "<|endoftext|>", "hello", "12", "x" * 50]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    calls = []
    assert tc._fitting(["one two."] * 1000, 0, 400, lambda text: calls.append(len(text)) or count(text)) == next(n for n in range(1, 1000) if count(" ".join(["one two."] * (n + 1))) > 400)
    assert sum(n > 50 for n in calls) == 2  # the guess and one more


def test_documents_are_not_a_call_each(spark):
    """a frame of pandas was made for each document."""
    b = spark.createDataFrame([(1, 0, "u", "list", None, None, None, None, "A b.", None, 0.0, 1.0, 1.0)], "doc_id long, ord long, uid string, kind string, section_uid string, section string, subsection string, page long, text string, x0 double, y0 double, x1 double, y1 double")
    found = tc.chunk_by_tokens(b, None)
    assert [(r.content, r.tokens, r.page_boxes) for r in found.collect()] == [("A b.", 2, {})]
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
