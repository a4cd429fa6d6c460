from __future__ import annotations

import random

import pytest
from tokenizers import Tokenizer

from graphloom.llm import tokens
from graphloom.llm.queries import QUERIES

from .helpers import ODD, frame, rows_of, same_with_clashes


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))


def test_counts_of_all_documents(spark, medium, library):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op6_token_counts"](spark, medium).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert tuple(r)[1:] == (len(docs[r["doc_id"]].encode()), n, n > 512)


def test_odd_rows(spark, library):
    docs = frame(spark, ODD)
    want = sorted(((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in ODD), key=repr)
    assert [r[:3] for r in rows_of(tokens.count_tokens(docs))] == want
    same_with_clashes(tokens.count_tokens, docs)
    assert tokens.count_tokens(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_and_splices(name):
    enc, rng = tokens.Encoder(name), random.Random(3)
    parts = ["word", " ", "  ", "\n", "\n\n", "'s", "don't", "123", "4", "é", "ü", "!?", "<|endoftext|>", "<|", "漢字", " ", "\xa0", "🙂", "a" * 70, "-" * 90, " " * 40, "\t"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(400)))
        ids = enc.library.encode(text, add_special_tokens=False).ids
        assert enc.ids([text.encode()])[0].tolist() == ids and enc.counts([text.encode()])[0] == len(ids)
        if name.startswith("byte"):
            for chunk, overlap in ((100, 40), (300, 90), (64, 8)):
                assert tokens.count_spliced(enc, text, chunk, overlap) == len(ids), (text, chunk, overlap)


def test_texts_without_a_boundary():
    enc = tokens.Encoder("byte_bpe_50k.json")
    for text in ("a" * 5000, " " * 5000, "é" * 4000, "漢" * 3000, "<|endoftext|>" * 300, "!" * 4000 + "a"):
        assert tokens.count_spliced(enc, text, 256, 64) == len(enc.library.encode(text, add_special_tokens=False).ids)


def test_more_words_than_the_cache_holds(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 50)
    enc = tokens.Encoder("byte_bpe_50k.json")
    for k in range(6):
        text = " ".join(f"w{i % (40 + 30 * k)}x" for i in range(400))
        assert enc.ids([text.encode()])[0].tolist() == enc.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_batches_of_short_texts(name):
    """Every order of white space, quotes, letters and numbers at the ends of texts."""
    enc, rng = tokens.Encoder(name), random.Random(5)
    texts = ["".join(rng.choice("ab'sdmtlvre  \n\t.,!1²½ÀéµØ×÷§''") for _ in range(rng.randrange(12))) for _ in range(4000)]
    texts += ["漢字 abc", "a\0b", " x", "'s", "'ll 've", "x  ", "  x", " 's", "", "\u200b's"]
    for ids, n, text in zip(enc.ids(t := [x.encode() for x in texts]), enc.counts(t), texts, strict=True):
        assert ids.tolist() == enc.library.encode(text, add_special_tokens=False).ids and n == len(ids), text
