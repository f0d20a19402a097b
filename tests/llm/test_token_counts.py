"""Prefix counts against the tokenizer library, prefix by prefix."""

import random
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomcast.llm import tokencounts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a", "e", "re", "'re", "'s", "'r", "'", "l", "'ll", " ", "  ", "\n", "́", "̖", "é", "é", "İ", "ß", "<|endoftext|>", "<|endof", "<|", "!", "12", "3",
    "日本", "กุ", "한", "ᄒ", "ᅡ", "ᆫ", "ΑΣ", "\U0001f602", "\x85", "\x1c", "\xa0", " ", "the", "ing", "Å", "ﬁ", "zzzzzzz",
]


@pytest.fixture(scope="module")
def tool():
    with open(PATH, "rb") as f:
        return tokencounts.Counter(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(PATH)
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


def test_every_prefix_equals_the_library(tool, library):
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choices(ODD, k=rng.randint(0, 14)))
        n, stored = tool.table(text)
        assert tokencounts.running(stored).tolist() == [library(text[:k]) for k in range(1, len(text) + 1)], repr(text)
        assert n == library(text)


def test_invented_words_equal_the_library(tool, library):
    rng = random.Random(4)
    for _ in range(1500):
        word = "".join(rng.choices("an er in th es la tion eou ßé sch qu".split(), k=rng.randint(1, 6)))
        assert tool.counts(word) == [library(word[:k]) for k in range(1, len(word) + 1)], word


@pytest.mark.parametrize("text", ["z" * 50_000, "ab" * 30_000, "é" * 20_000, "!" * 50_000, "e" + "́" * 20_000, "'" * 3000 + "re" * 20_000])
def test_long_pieces_take_time_in_proportion(tool, library, text):
    began = time.time()
    n, _ = tool.table(text)
    assert time.time() - began < 20
    assert n == library(text)


def test_falling_counts_and_wide_steps(tool):
    n, stored = tool.table("a <|endoftext|>")
    counts = tokencounts.running(stored)
    assert n == 2 and counts.max() > 2 and counts[-1] == 2
    tool.runs.clear()
    assert tokencounts.running(b"\4" + b"\x90\x01\0\0\xff\xff\xff\xff").tolist() == [400, 399]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
            tokencounts.Counter(f.read())


def test_relation(spark, library):
    texts = ["", None, "The end.\nNot  yet", "word " * 3000, "a <|endoftext|> b", "The end.\nNot  yet", "x" * 30_000]
    rows = [(k, t, "clash", "clash", k) for k, t in enumerate(texts)] + [(None, "no id", "", "", 0), (2, texts[2], "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, steps string, keep_chars int")
    stored = tokencounts.prefix_counts(docs, PATH)
    got = sorted((r.doc_id is not None, r.doc_id, r.n_bytes, r.n_chars, r.n_tokens) for r in stored.collect())
    assert got == sorted((r[0] is not None, r[0], len((r[1] or "").encode()), len(r[1] or ""), library(r[1] or "")) for r in rows)
    cut = {r.doc_id: r for r in tokencounts.truncate(stored.where("doc_id is not null"), 2048).collect()}
    assert (cut[3].keep_chars, cut[3].keep_tokens) == (len("word " * 2048), 2048)
    for k in (0, 1, 2, 4):
        assert (cut[k].keep_chars, cut[k].keep_tokens) == (len(texts[k] or ""), library(texts[k] or ""))
    none = tokencounts.truncate(stored, 0).where("doc_id = 2").head()
    assert (none.keep_chars, none.keep_tokens) == (0, 0)
    at = tokencounts.tokens_at(stored.where("doc_id = 4").withColumn("p", F.expr("array(0, 1, 10, 17, 99, null)")), "p").head()
    assert at.tokens_at == [0, 1, library("a <|endoft"), 3, None, None]
    assert tokencounts.totals(stored, 2048).where("over_limit").count() == sum(library(t or "") > 2048 for t in texts)
    assert tokencounts.prefix_counts(docs.limit(0), PATH).count() == 0
