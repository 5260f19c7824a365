import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tiffin.llm import nbest, tokenfile
from tiffin.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# ------------------------------------------------------------------ byte-aligned ids
def test_pack_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = rng.integers(0, 1 << rng.choice([7, 9, 17, 32], n), dtype=np.uint64).astype(np.uint32) if n else np.empty(0, np.uint32)
        control, data = tokenfile.pack(v)
        assert len(control) == -(-n // 4)
        assert (tokenfile.unpack(control, data, n) == v).all()
    for edge in (0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1):
        control, data = tokenfile.pack(np.array([edge]))
        assert len(data) == max(1, (edge.bit_length() + 7) // 8) and tokenfile.unpack(control, data, 1)[0] == edge


def test_block_round_trip():
    docs = [np.array([1, 300, 70000], np.uint32), np.empty(0, np.uint32), np.array([5], np.uint32)]
    ids, lengths, values = tokenfile.read_block(tokenfile.write_block([None, -4, 9], docs))
    assert ids == [None, -4, 9] and lengths.tolist() == [3, 0, 1] and values.tolist() == [1, 300, 70000, 5]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer
    with open(WORD_BPE, encoding="utf-8") as f:
        text = f.read()
    library, mine = Tokenizer.from_str(text), tokenfile.Encoder(text)
    assert mine.by_pre_token
    rng = random.Random(2)
    letters = "".join(map(chr, range(256))) + "œŒ漢字İΣς́'sST <|endoftext|>\x1c\x85"
    texts = ["", "It's we'll 12 ab12 x_y Straße", "<|endoftext|> a"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    for t, ids in zip(texts, mine.encode(texts)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def brute_tokens(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(WORD_BPE)
    out, start = [], 0
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_match_brute_force(spark, sf):
    from tiffin.llm.queries import QUERIES
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect())
    got = sorted(tuple(r) for r in QUERIES["op3_token_files"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == brute_tokens(docs)


def test_token_files_edge_cases(spark, nasty, empty, tmp_dir, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_DOCS", 2)
    tokenfile.write_tokens(nasty, f"{tmp_dir}/t", WORD_BPE)
    got = tokenfile.read_tokens(spark, f"{tmp_dir}/t").collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in got if r["n_tokens"] == 1) == [(True, 3, 1), (True, 4, 1), (True, 5, 1)]
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [None, 1, 2, 2, 3, 4, 5, 6, 8, 9, 10, 11]      # null ids first, then ascending
    assert [r["start"] for r in ordered] == np.cumsum([0] + [r["n_tokens"] for r in ordered])[:-1].tolist()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[3]["ids"] == [2] and len(by_id[9]["ids"]) == by_id[9]["n_tokens"]
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    tokenfile.write_tokens(empty, f"{tmp_dir}/e", WORD_BPE)
    assert tokenfile.read_tokens(spark, f"{tmp_dir}/e").count() == 0


# ------------------------------------------------------------------ n-best segmentation
@pytest.fixture(scope="module")
def pieces():
    return nbest.Pieces.load(PIECES)


def all_paths(word, pieces):
    out = []

    def go(i, ids, score):
        if i == len(word):
            out.append((score, tuple(ids)))
            return
        if word[i] not in pieces.ids:
            go(i + 1, ids + pieces.spelled(word[i]), score + pieces.unknown)
        for end in range(i + 1, min(len(word), i + pieces.longest) + 1):
            if word[i:end] in pieces.ids:
                go(end, ids + [pieces.ids[word[i:end]]], score + pieces.scores[pieces.ids[word[i:end]]])
    go(0, [], 0.0)
    return sorted(out, key=lambda x: -x[0])


def test_paths_match_all_segmentations(pieces):
    rng = random.Random(1)
    words = list(dict.fromkeys(["▁hello", "▁▁the,", "a", "▁", "\n", "▁größe☃x", "▁▁▁", "漢☃"] +
                               ["▁" + "".join(rng.choice("abcdetionsh,.é") for _ in range(rng.randint(1, 8))) for _ in range(60)]))
    memory = nbest.Memory(pieces)
    numbers = np.array([memory[w] for w in words])
    memory.learn()
    for w, k in zip(words, numbers):
        every = all_paths(w, pieces)
        assert [x[0] for x in nbest.best_paths(w, pieces, 5)] == pytest.approx([x[0] for x in every[:5]])
        assert memory.score[k] == pytest.approx(every[0][0])
        assert memory.loss[k] == pytest.approx(every[0][0] - every[1][0]) if len(every) > 1 else np.isinf(memory.loss[k])
    for text in ("the cat  sat\non it ", "x", "  ", "größe ☃"):
        w = nbest.chunks(text)
        numbers = np.array([memory[x] for x in w])
        memory.learn()
        got = nbest.segment(w, numbers, memory, 6)
        every = all_paths("▁" + text.replace(" ", "▁"), pieces)[:6]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in every])
        assert len({tuple(i.tolist()) for _, i in got}) == len(got)
        assert pieces.decode(got[0][1].tolist()) == text


def test_chunks_match_their_pattern():
    rng = random.Random(8)
    for t in ["", " ", "\n", "a", " a", "a ", "\n\n a \n"] + ["".join(rng.choice("ab  \n\t▁é"[:rng.choice((4, 5, 9))]) for _ in range(rng.randint(1, 12))) for _ in range(5000)]:
        assert nbest.chunks(t) == (nbest._CHUNK.findall("▁" + t.replace(" ", "▁")) if t else []), repr(t)


def test_a_memory_forgets_words_and_goes_on(pieces):
    memory = nbest.Memory(pieces)
    solve = lambda w: ([memory[x] for x in w], memory.learn(), [memory.alternatives(x, 3) for x in w])[2]
    first = solve(["▁hello", "▁world", "▁☃"])
    memory.forget()
    assert len(memory) == len(memory.score) == 0 and solve(["▁☃", "▁hello"]) == [first[2], first[0]]


def brute_counts(texts):
    from sentencepiece import SentencePieceProcessor
    out = {}
    for ids in SentencePieceProcessor(model_file=PIECES).encode([t for t in texts if t], num_threads=1):
        for i in ids:
            out[i] = out.get(i, 0) + 1
    return out


def test_piece_counts_and_their_paths(spark, nasty, empty, sf, monkeypatch):
    """Counts equal the library's on whole texts; paths by their log-frequencies need about as few pieces as the library's."""
    odd = [r["text"] for r in nasty.collect()] + ["a\nb\n\n  c ", "\n", " ", "x\ty\r\nz", "\n漢字\n"]
    assert nbest.piece_counts(spark.createDataFrame([(t,) for t in odd], "text string"), PIECES) == brute_counts(odd)
    assert nbest.piece_counts(empty, PIECES) == {}
    docs = table(spark, sf, "documents")
    texts = [r["text"] for r in docs.collect()]
    monkeypatch.setattr(nbest, "COUNTED", 50)
    counts = nbest.piece_counts(docs, PIECES)
    assert counts == brute_counts(texts)
    n = nbest.encode(docs, PIECES, n=1, counts=counts).agg({"n_pieces": "sum"}).first()[0]
    assert n <= 1.02 * sum(counts.values())
    few = nbest.encode(docs, PIECES, n=3, counts=counts, remembered=100, keep_words=False).collect()
    assert sorted(few) == sorted(nbest.encode(docs, PIECES, n=3, counts=counts).collect())
    ranks = nbest.encode(docs, PIECES, n=1).agg({"n_pieces": "sum"}).first()[0]
    assert ranks > 1.1 * n


def test_n_best_of_texts_match_all_segmentations_by_frequency(pieces):
    rng = random.Random(3)
    known = nbest.Pieces.load(PIECES, {i: rng.randint(0, 5) for i in pieces.ids.values()})
    assert all(known.unknown < known.scores[i] <= 0 for i in known.ids.values())
    memory = nbest.Memory(known)
    for text in ["the cat", "aaaa aa\naa", "on it ☃", "größe x"] + ["".join(rng.choice("aabetn  \n,") for _ in range(9)) for _ in range(30)]:
        w = nbest.chunks(text)
        numbers = np.array([memory[x] for x in w])
        memory.learn()
        every = all_paths("▁" + text.replace(" ", "▁"), known)
        for n in (1, 4):
            got = nbest.segment(w, numbers, memory, n)
            assert [s for s, _ in got] == [s for s, _ in every[:n]]          # sums of these scores are exact
            assert len({tuple(i.tolist()) for _, i in got}) == len(got) and all((s, tuple(i.tolist())) in every for s, i in got)


def test_segmentation_operator(spark, nasty, empty):
    got = nbest.encode(nasty, PIECES, n=3)
    rows = got.collect()
    assert len(rows) == nasty.count() and all(r["round_trip"] for r in rows)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] == r["best"][0]["ids_crc32"]
        scores = [b["score"] for b in r["best"]]
        assert scores == sorted(scores, reverse=True)
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_pieces"] == by[4]["n_pieces"] == 0 and [b["score"] for b in by[3]["best"]] == [0.0]
    text = {r["doc_id"]: r["text"] for r in nasty.collect()}
    back = {r["doc_id"]: r["text"] for r in nbest.decode(got, PIECES).collect()}
    assert all(back[i] == (text[i] or "") for i in text)
    assert nbest.encode(empty, PIECES).count() == 0
    lossy = nbest.encode(spark.createDataFrame([(1, "a▁b")], "doc_id long, text string"), PIECES).first()
    assert not lossy["round_trip"]                       # the space mark itself becomes a space


def test_segmentation_query(spark, sf):
    from tiffin.llm.queries import QUERIES
    rows = QUERIES["op9_nbest_segmentation"](spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count() and all(r["round_trip"] and len(r["best"]) == 4 for r in rows if r["n_pieces"] > 3)


def test_models_are_told_apart_and_prefixes_have_no_limit():
    import itertools
    import numpy as np
    from tiffin.llm import nbest
    text = [bytes([i]) for i in range(256)]
    byte_id = list(range(256))

    def model(pieces, scores):
        return nbest.Pieces({p: 256 + i for i, p in enumerate(pieces)}, np.array([-9.0] * 256 + scores), byte_id, text + [p.encode() for p in pieces], -30.0)

    many = [chr(97 + i) * 3 for i in range(60)]
    a, b = model(many + ["xy", "yz"], [-1.0] * 60 + [-2.0, -3.0]), model(many + ["xy", "yz"], [-1.0] * 60 + [-3.0, -2.0])
    assert a.digest != b.digest and nbest._memory(a) is not nbest._memory(b) and nbest._memory(a) is nbest._memory(model(many + ["xy", "yz"], [-1.0] * 60 + [-2.0, -3.0]))
    letters = [chr(0x4E00 + i) for i in range(104)]                                # 1,135,784 prefixes, more than 2^20
    big = ["".join(t) for t in itertools.product(letters, repeat=3)]
    memory = nbest.Memory(model(big, [-1.0] * len(big)))
    h, wanted = [], []
    for piece in (big[0], big[-1], big[77_777]):
        x = 0
        for c in piece:
            x = memory._roll(x, ord(c))
        h.append(x), wanted.append(256 + big.index(piece))
    assert memory.piece[memory._find(np.array(h + [12345], np.uint64))].tolist() == wanted + [-1]


def test_pre_tokens_follow_the_rule_of_the_tokenizer_file():
    import re
    rule = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x20\x09-\x0Da-zß-öø-ÿ0-9]+")
    rng = random.Random(4)
    texts = ["", "'", "'s", "''s", "a's'tx", "x'llama", "'re", "'r", "y 've!'d", "12'm\x1c", "\n \t"] + \
        ["".join(rng.choice("'''streveldm1! \né") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for t in texts:
        raw = t.encode("latin-1")
        start, end = tokenfile.pre_tokens(np.frombuffer(raw, np.uint8))
        assert [raw[a:b].decode("latin-1") for a, b in zip(start, end)] == rule.findall(t), repr(t)


def test_encoder_equals_the_library_when_hashes_meet_and_windows_are_small(monkeypatch):
    """With radix 1 all anagrams have one hash; long words outgrow a window; the memory is emptied again and again."""
    from tokenizers import Tokenizer
    with open(WORD_BPE, encoding="utf-8") as f:
        text = f.read()
    library = Tokenizer.from_str(text)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abe'1") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["x" * 500 + " ab ba", None, ""]
    monkeypatch.setattr(tokenfile, "WINDOW", 64)
    for radix, remembered in ((1, 10**6), (1, 20), (0x9E3779B97F4A7C15, 20), (0x9E3779B97F4A7C15, 10**6)):
        monkeypatch.setattr(tokenfile.PreTokenMemory, "RADIX", radix)
        monkeypatch.setattr(tokenfile, "REMEMBERED", remembered)
        mine = tokenfile.Encoder(text)
        for _ in range(2):
            assert [i.tolist() for i in mine.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert bool(mine.memory.same_hash) == (radix == 1) or remembered == 20


def test_a_growing_memory_finds_all_its_pre_tokens_again():
    with open(WORD_BPE, encoding="utf-8") as f:
        coder = tokenfile.Encoder(f.read())
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{'xyzw'[i // 17576]}" for i in range(40_000)]
    first = [i.tolist() for i in coder.encode([" ".join(words), " ".join(words[::-1])])]
    assert coder.memory.n == len(words) and coder.memory.bits > 16
    assert [i.tolist() for i in coder.encode([" ".join(words), " ".join(words[::-1])])] == first and coder.memory.n == len(words)


def test_pieces_are_counted_with_few_words_and_ids_held(monkeypatch):
    from sentencepiece import SentencePieceProcessor
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefg  \n☃") for _ in range(300)) for _ in range(200)]

    class Watched:
        def __init__(self):
            self.sp, self.most = SentencePieceProcessor(model_file=PIECES), 0

        def get_piece_size(self):
            return self.sp.get_piece_size()

        def encode(self, words, **kind):
            self.most = max(self.most, len(words))
            return self.sp.encode(words, **kind)

    for counted, encoded in ((500, 64), (10**6, 1000)):
        monkeypatch.setattr(nbest, "COUNTED", counted)
        monkeypatch.setattr(nbest, "ENCODED", encoded)
        sp = Watched()
        total = nbest.count_pieces(texts, sp)
        assert {i: int(total[i]) for i in np.flatnonzero(total)} == brute_counts(texts) and sp.most == encoded
