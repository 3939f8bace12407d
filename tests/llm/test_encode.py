"""Prefix tables against an independent encoder of the same vocabulary."""

import os

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.encode import PATTERN, TOKENIZERS, EncodedText, PrefixEncoder, PrefixTable, encode_corpus, read_ranks

FILE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="the vocabulary isn't here")
RANKS = read_ranks(FILE) if os.path.exists(FILE) else {}
CODER = PrefixEncoder(RANKS) if RANKS else None
OTHER = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={}) if RANKS else None
TEXTS = st.one_of(st.text(max_size=60), st.text(alphabet="ab 'rel s\n\t1é漢😀'", max_size=40))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_same_ids_and_round_trip(text):
    ids = CODER.encode(text)
    assert ids == OTHER.encode_ordinary(text) and CODER.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), TEXTS), max_size=4), TEXTS)
def test_edits_and_appends(text, edits, more):
    t = EncodedText(CODER, text)
    for a, b, new in edits:
        a, b = sorted((min(a, len(t.text)), min(b, len(t.text))))
        t.edit(a, b, new)
        assert t.ids() == OTHER.encode_ordinary(t.text)
    t.append(more)
    assert t.ids() == OTHER.encode_ordinary(t.text)


def test_every_prefix_is_encoded():
    data = " internationalisation".encode()
    table = PrefixTable(CODER)
    for i in range(len(data)):
        table.extend(data[i : i + 1])
    for n in range(len(data) + 1):
        assert table.ids(n) == CODER.merged(data[:n])


def test_an_edit_touches_only_pieces_near_it():
    t = EncodedText(CODER, "the quick brown fox jumps over the lazy dog " * 200)
    assert t.edit(4000, 4003, "xyz") < 10 and t.append(" again") < 4


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 5000, "\n \t" * 2000, "é😀" * 1500, "<|endoftext|>", "\x00\x01"])
def test_long_and_odd_texts(text):
    assert CODER.encode(text) == OTHER.encode_ordinary(text)


def test_corpus(spark):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello world", "x"), (4, "  \n", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in encode_corpus(df, "doc_id", "text").collect())
    assert got == sorted((i, OTHER.encode_ordinary(t or "")) for i, t, _ in rows)
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = encode_corpus(docs, "doc_id", "text").collect()
    assert len(got) == len(texts) and all(list(r["ids"]) == OTHER.encode_ordinary(texts[r["doc_id"]] or "") for r in got)
