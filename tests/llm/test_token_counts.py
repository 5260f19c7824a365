import random

import numpy as np
import public_tokenizers
import pytest

from tiffin.llm import tokencount as tc
from tiffin.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    with open(WORD_BPE, "rb") as f:
        return tc._library("json", f.read())


def table_of(library, words):
    raw = [w.encode("latin-1").ljust(16, b"\0") for w in words]
    low, high = (np.array([int.from_bytes(w[k:k + 8], "little") for w in raw], np.uint64) for k in (0, 8))
    return tc.Table(low, high, library.sizes(words).astype(np.uint8))


def test_counts_equal_the_library_with_and_without_table(library):
    rng = random.Random(5)
    letters = "".join(map(chr, range(256))) + "œŒ漢字İΣς'''sSTrevmld <|endoftext|>\x1c\x85  "
    texts = ["", None, "It's we'll 12 ab12 Straße 'supper don''t '' 's' 're've", "<|endoftext|> a x<|endoftext|>y", "\0 \0\0 a\0"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice("ab'stre ve mld1\n") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    want = [library.whole(t) if t else 0 for t in texts]
    for words in ([], ["a", "b", "'s", "'", "''", "re", "ab", "the", "1"]):
        assert tc._count(library, table_of(library, words), texts).tolist() == want


def test_table_finds_what_was_put_in_and_nothing_else():
    rng = np.random.default_rng(1)
    low, high = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 3, 5000).astype(np.uint64)
    tokens = rng.integers(1, 30, 5000).astype(np.uint8)
    t = tc.Table(low, high, tokens)
    assert (t.find(low, high) == tokens).all()
    assert (t.find(low + np.uint64(1), high + np.uint64(7)) == 0).all()


def test_slabs_and_long_words(library, monkeypatch):
    text = " ".join(f"word{i % 977} don't" for i in range(3000)) + " " + "x" * 5000
    want = library.whole(text)
    monkeypatch.setattr(tc, "SLAB", 500)
    assert tc._count(library, table_of(library, ["word", "don"]), ["a", text, None, "b c"]).tolist() == [1, want, 0, 2]


def test_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(2)
    a, b = tc._Summary(8), tc._Summary(8)
    stream = np.concatenate([np.repeat(np.arange(4), 500), np.arange(100, 2100)])
    rng.shuffle(stream)
    for part, s in ((stream[:1500], a), (stream[1500:], b)):
        for lo in range(0, len(part), 100):
            x = part[lo:lo + 100].astype(np.uint64)
            s.add(x, np.zeros_like(x), np.ones(len(x), np.int64))
    a.add(b.low, b.high, b.n)
    assert set(range(4)) <= set(a.low.tolist()) and len(a.low) <= 32


def test_query_matches_the_library(spark, sf, library):
    from tiffin.llm.queries import QUERIES
    docs = table(spark, sf, "documents").collect()
    want = {(r["doc_id"], len((r["text"] or "").encode()), n, n > 2048)
            for r in docs for n in [library.whole(r["text"]) if r["text"] else 0]}
    got = QUERIES["op11_token_counts"](spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and {tuple(r) for r in got.collect()} == want


def test_piece_models_and_other_json_files(spark, sf):
    import sentencepiece
    from tokenizers import Tokenizer
    docs = table(spark, sf, "documents").limit(40)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r["n_tokens"] for r in tc.count_tokens(docs, PIECES, 100).collect()}
    assert got == {i: len(pieces.encode(t)) for i, t in texts.items()}
    other = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(other)
    got = {r["doc_id"]: r["n_tokens"] for r in tc.count_tokens(docs, other, 100).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts.items()}
    with pytest.raises(ValueError):
        tc.count_tokens(docs, "ranks.tiktoken", 100)


def test_odd_rows(spark, nasty, empty, library):
    got = tc.count_tokens(nasty, WORD_BPE, 50)
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, len((r["text"] or "").encode()), n, n > 50)
                  for r in nasty.collect() for n in [library.whole(r["text"] or "")])
    assert sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in got.collect()) == want
    assert tc.count_tokens(empty, WORD_BPE, 50).count() == 0
