"""Token ids on disk: frequency-ranked ids, byte-aligned variable length, control bytes apart from data.

Every id is replaced by its rank in the corpus (0 = most frequent) and stored in
one to four bytes. Four two-bit lengths make one control byte; all control bytes
of a block come before its data bytes, so decoding is a numpy table lookup.

A token table is a folder with two Parquet tables, written by Spark's committer:
``codebook`` (rank, id, n) and ``blocks`` (part, seq, start_in_part, n_values,
block). Parts and blocks hold documents in ascending id order. A block is
self-describing bytes: header, document ids, document lengths, control, data.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import stage

MAGIC = b"FRV1"
_HEAD = struct.Struct("<4sIQ")   # magic, documents, values
#: A block is closed at this many values or documents; a longer document has a block of its own.
BLOCK_VALUES, BLOCK_DOCS = 1 << 20, 4096
#: Pre-tokens in a worker's memory before it is emptied; bytes of text cut into pre-tokens at once (more for one long word).
REMEMBERED, WINDOW = 800_000, 1 << 18

#: Lengths of the four values of a control byte.
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
#: Which of the sixteen bytes of its four values a control byte keeps.
_KEPT = (np.arange(4) < _LENGTHS[:, :, None]).reshape(256, 16)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    c = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    top = int(v.max(initial=0))
    for k in (8, 16, 24):
        if top >> k:
            c[:len(v)] += v >= 1 << k
    control = c[0::4] | c[1::4] << 2 | c[2::4] << 4 | c[3::4] << 6
    data = v.view(np.uint8)[_KEPT[control].reshape(-1)[:4 * len(v)]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    has = np.flatnonzero(size > 1)
    k = 1
    while len(has):
        out[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
        k += 1
        has = has[size[has] > k]
    return out


def write_block(ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    values = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    control, data = pack(values)
    return b"".join([_HEAD.pack(MAGIC, len(ids), len(values)), np.array([i is not None for i in ids], np.uint8).tobytes(),
                     np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([len(d) for d in docs], "<u4").tobytes(), control, data])


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, values)."""
    magic, docs, n = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = _HEAD.size
    known = np.frombuffer(block, np.uint8, docs, at)
    ids = np.frombuffer(block, "<i8", docs, at := at + docs)
    lengths = np.frombuffer(block, "<u4", docs, at := at + 8 * docs)
    at += 4 * docs
    control = -(-n // 4)
    values = unpack(block[at:at + control], block[at + control:], n)
    return [i if k else None for i, k in zip(ids.tolist(), known.tolist())], lengths, values


# ------------------------------------------------------------------ encoding
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
#: What the bytes of lower-case Latin-1 texts are to the tokenizer's rule.
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_U = np.uint64


def pre_tokens(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the pre-tokens of lower-case Latin-1 bytes: contractions, letter runs, single digits, other runs."""
    n, kind = len(text), _KIND[text]
    first = kind == _DIGIT
    first[:1] = True
    first[1:] |= kind[1:] != kind[:-1]
    # A contraction starts where a run does; letters after it are a run of their own.
    mark = np.flatnonzero(first & (text == 0x27))
    mark = mark[mark + 1 < n]
    a, b = text[mark + 1], text[np.minimum(mark + 2, n - 1)]
    size = np.zeros(len(mark), np.int64)
    size[np.isin(a, list(b"stmd"))] = 2
    size[(mark + 2 < n) & (((b == 0x65) & ((a == 0x72) | (a == 0x76))) | ((a == 0x6C) & (b == 0x6C)))] = 3     # re, ve, ll
    mark, size = mark[size > 0], size[size > 0]
    first[mark + 1] = False
    after = (mark + size)[mark + size < n]
    first[after[kind[after] == _LETTER]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], n)
    kept = kind[start] != _SPACE
    return start[kept], end[kept]


def _put(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``more`` after the first ``n`` values of ``held``, which doubles when it is full."""
    if n + len(more) > len(held):
        held = np.concatenate([held[:n], np.empty(max(n, len(more)), held.dtype)])
    held[n:n + len(more)] = more
    return held


class PreTokenMemory:
    """Numbers of pre-tokens, found many at a time by a hash of their bytes and compared byte by byte, and the ids of each.

    New pre-tokens are encoded many at a time, as one text with spaces between
    them; each ends with the one id that carries the word-end mark. Of pre-tokens
    with one hash the first is found by it, any other in a dictionary.
    """

    AT_ONCE, RADIX = 256, 0x9E3779B97F4A7C15

    def __init__(self, tokenizer, ends_word: np.ndarray):
        self.tokenizer, self.ends_word = tokenizer, ends_word
        # By number, from 1 on: where its bytes and its ids start (so also where those before it end).
        self.n, self.at, self.first = 0, np.zeros(2, np.int64), np.zeros(2, np.int64)
        self.text, self.flat, self.hash = np.empty(0, np.uint8), np.empty(0, np.int32), np.zeros(1, _U)
        self.slots, self.bits, self.same_hash = np.zeros(1 << 16, np.int32), 16, {}
        self.power, self.inverse = np.empty(0, _U), np.empty(0, _U)

    def _hash(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(text) > len(self.power):
            for name, base in (("power", self.RADIX), ("inverse", pow(self.RADIX, -1, 1 << 64))):
                factor = np.full(2 * len(text), base, _U)
                factor[0] = 1
                setattr(self, name, np.cumprod(factor))
        total = np.concatenate([np.zeros(1, _U), np.cumsum((text.astype(_U) + _U(1)) * self.power[:len(text)])])
        h = (total[end] - total[start]) * self.inverse[start]
        return (h ^ h >> _U(32)) * _U(0xD6E8FEB86659FD93)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pre-tokens with these hashes, 0 for none: open addressing, all lookups at once."""
        at = (h >> _U(64 - self.bits)).astype(np.int64)
        out = self.slots[at]
        wrong = np.flatnonzero((out > 0) & (self.hash[out] != h))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % len(self.slots)
            out[wrong] = self.slots[at[wrong]]
            wrong = wrong[(out[wrong] > 0) & (self.hash[out[wrong]] != h[wrong])]
        return out

    def _enter(self, numbers: np.ndarray) -> None:
        at = (self.hash[numbers] >> _U(64 - self.bits)).astype(np.int64)
        while len(numbers):
            free = self.slots[at] == 0
            self.slots[at[free]] = numbers[free]
            out = self.slots[at] != numbers       # taken before, or by another of these
            numbers, at = numbers[out], (at[out] + 1) % len(self.slots)

    def _add(self, words: list[bytes], h: np.ndarray) -> None:
        """Number ``words`` from ``n`` + 1 on."""
        coded, size = [], []
        for lo in range(0, len(words), self.AT_ONCE):
            part = words[lo:lo + self.AT_ONCE]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode("latin-1"), add_special_tokens=False).ids, np.int32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not end each pre-token with a word-end id")
            coded.append(ids), size.append(np.diff(ends, prepend=0))
        used, kept, n = int(self.first[self.n + 1]), int(self.at[self.n + 1]), self.n
        self.flat = _put(self.flat, used, np.concatenate(coded))
        self.text = _put(self.text, kept, np.frombuffer(b"".join(words), np.uint8))
        self.first = _put(self.first, n + 2, used + np.cumsum(np.concatenate(size)))
        self.at = _put(self.at, n + 2, kept + np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))
        self.hash = _put(self.hash, n + 1, h)
        self.n += len(words)

    def numbers(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the pre-tokens of ``raw``; new ones are learned."""
        text, size = np.frombuffer(raw, np.uint8), end - start
        h = self._hash(text, start, end)
        out = self._find(h)
        new = np.flatnonzero(out == 0)
        if len(new):
            one, which = np.unique(h[new], return_index=True)
            pick = new[which]
            n = self.n
            self._add([raw[s:e] for s, e in zip(start[pick].tolist(), end[pick].tolist())], one)
            fresh = np.arange(n + 1, self.n + 1, dtype=np.int32)
            if 4 * self.n > len(self.slots):
                while 4 * self.n > 1 << self.bits:
                    self.bits += 1
                self.slots, fresh = np.zeros(1 << self.bits, np.int32), np.setdiff1d(np.arange(1, self.n + 1, dtype=np.int32), [*self.same_hash.values()])
            self._enter(fresh)
            out[new] = self._find(h[new])
        # Same hash, other bytes: one by one.
        fits = self.at[out + 1] - self.at[out] == size
        whole = np.flatnonzero(fits)
        ends = np.cumsum(size[whole])
        step = np.arange(ends[-1] if len(ends) else 0)
        differs = self.text[np.repeat(self.at[out[whole]] - ends + size[whole], size[whole]) + step] != \
            text[np.repeat(start[whole] - ends + size[whole], size[whole]) + step]
        fits[whole[np.searchsorted(ends, np.flatnonzero(differs), side="right")]] = False
        for i in np.flatnonzero(~fits).tolist():
            word = raw[start[i]:end[i]]
            if word not in self.same_hash:
                self._add([word], h[i:i + 1])
                self.same_hash[word] = self.n
            out[i] = self.same_hash[word]
        return out

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens one after another, how many each has)."""
        first, size = self.first[numbers], self.first[numbers + 1] - self.first[numbers]
        end = np.cumsum(size)
        return self.flat[np.repeat(first - end + size, size) + np.arange(end[-1] if len(end) else 0)], size


class Encoder:
    """Whole texts to ids with a tokenizer whose pre-tokens do not depend on one another.

    Texts of ASCII and Latin letters are cut into pre-tokens here, by the rule the
    tokenizer file states (contractions, letter runs, single digits, other runs;
    lower case), and each distinct pre-token is encoded once by the tokenizer,
    without the steps already done: such letters are in normal form, and spaces
    set the pre-tokens apart. Any other text, or one that spells a special token,
    goes to it whole.
    """

    RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"    # as the tokenizer file states it
    PLAIN = bytes(range(0x80)) + bytes(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))   # ASCII and Latin letters

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        rules = json.loads(tokenizer_json)
        suffix = rules["model"].get("end_of_word_suffix")
        stated = json.dumps(rules.get("pre_tokenizer"))
        self.by_pre_token = bool(suffix) and json.dumps(self.RULE) in stated and '"Lowercase"' in json.dumps(rules.get("normalizer"))
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = bool(suffix) and token.endswith(suffix)
        self.by_word = Tokenizer.from_str(tokenizer_json)
        if self.by_pre_token:
            self.by_word.normalizer = None
            self.by_word.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memory = PreTokenMemory(self.by_word, self.ends_word)

    def _plain(self, text: str) -> bool:
        if not text.isascii():
            try:
                if text.encode("latin-1").translate(None, self.PLAIN):
                    return False
            except UnicodeEncodeError:
                return False
        return not any(s in text for s in self.special)

    def _ids(self, raw: bytes, cuts: np.ndarray) -> list[np.ndarray]:
        """Ids of the texts in lower-case Latin-1 ``raw``, each followed by a line break; ``cuts``: where each ends."""
        ids, at, lo = [], [], 0
        while lo < len(raw):
            # Windows end after white space, which no pre-token holds.
            hi = min(lo + WINDOW, len(raw))
            while hi < len(raw) and _KIND[raw[hi - 1]] != _SPACE:
                hi += 1
            part = raw[lo:hi]
            start, end = pre_tokens(np.frombuffer(part, np.uint8))
            if self.memory.n > REMEMBERED:
                self.memory = PreTokenMemory(self.by_word, self.ends_word)
            got, size = self.memory.ids(self.memory.numbers(part, start, end))
            ids.append(got), at.append(np.repeat(start + lo, size))
            lo = hi
        whole = np.concatenate(ids)
        ends = np.searchsorted(np.concatenate(at), cuts).tolist()
        return [whole[a:e] for a, e in zip([0] + ends, ends)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        plain = [bool(t) and self.by_pre_token and self._plain(t) for t in texts]
        mine = [t.lower().encode("latin-1") + b"\n" for t, p in zip(texts, plain) if p]
        done = iter(self._ids(b"".join(mine), np.cumsum([len(m) for m in mine])) if mine else ())
        none = np.empty(0, np.int32)
        return [next(done) if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) if t else none
                for t, p in zip(texts, plain)]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(tokenizer_json: str) -> Encoder:
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # a task has one core
        _ENCODERS[key] = Encoder(tokenizer_json)
    return _ENCODERS[key]


#: Texts encoded at once inside a batch: bounds the pre-tokens held.
GROUP = 128


def encode(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, ids): whole texts encoded without special tokens, ``end_id`` appended. Null texts are empty.

    ``ids`` are little-endian unsigned 32-bit (16-bit if all ids fit); ``key`` orders rows that repeat an id.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(text)
    dtype = id_type(text, end_id)

    def run(batches: Iterator[pa.RecordBatch]):
        coder, tail = _encoder(shared.value), np.array([] if end_id is None else [end_id], dtype)
        for b in batches:
            for lo in range(0, b.num_rows, GROUP):
                part = b.slice(lo, GROUP)
                ids = [np.concatenate([x.astype(dtype), tail]).tobytes() for x in coder.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                                                  pa.array(ids, pa.binary())], names=["doc_id", "key", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, key long, ids binary")


def id_type(tokenizer_json: str, end_id: int | None) -> str:
    from tokenizers import Tokenizer
    return "<u2" if max(Tokenizer.from_str(tokenizer_json).get_vocab_size(), end_id or 0) < 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write a token table to ``path`` (shared storage), in ascending document id order.

    Null ids come first. The codebook counts all ids of all documents; it and the
    number of parts are all that reaches the driver.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        dtype = id_type(f.read(), end_id)
    coded = stage(encode(docs, tokenizer_path, end_id, id_col, text_col), "tokens")

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype), minlength=len(total))
            n[:len(total)] += total
            total = n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    counts = coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    counts = counts.sort_values(["n", "id"], ascending=[False, True], ignore_index=True)
    spark.createDataFrame(counts.rename_axis("rank").reset_index()[["rank", "id", "n"]], "rank long, id long, n long") \
        .coalesce(1).write.parquet(f"{path}/codebook")
    rank = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.uint32)
    rank[counts["id"].to_numpy(np.int64)] = np.arange(len(counts))
    shared = spark.sparkContext.broadcast(rank)

    def blocks(batches):
        from pyspark import TaskContext
        part, seq, done, held = TaskContext.get().partitionId(), 0, 0, 0
        ids, docs_ = [], []

        def close():
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, seq, done, held)] + [pa.array([write_block(ids, docs_)], pa.large_binary())],
                                              names=["part", "seq", "start_in_part", "n_values", "block"])
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = shared.value[np.frombuffer(x, dtype)]
                if ids and (held + len(v) > BLOCK_VALUES or len(ids) >= BLOCK_DOCS):
                    yield close().cast(_BLOCKS)
                    seq, done, held, ids, docs_ = seq + 1, done + held, 0, [], []
                ids.append(i), docs_.append(v)
                held += len(v)
        if ids:
            yield close().cast(_BLOCKS)

    # Keys repeat only for equal rows, so parts are ranges of (doc_id, key) even if one id repeats.
    coded.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key").select("doc_id", "ids") \
        .mapInArrow(blocks, "part long, seq long, start_in_part long, n_values long, block binary").write.parquet(f"{path}/blocks")


_BLOCKS = pa.schema([(n, pa.int64()) for n in ("part", "seq", "start_in_part", "n_values")] + [("block", pa.binary())])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids before the document in the table), n_tokens, ids_crc32 and, if asked for, ids, per document.

    The offsets of the parts (one number per file) are the only rows the driver sees.
    """
    stored = spark.read.parquet(f"{path}/blocks")
    book = spark.read.parquet(f"{path}/codebook").select("rank", "id").toArrow().to_pandas()
    id_of = np.zeros(len(book), "<u4")
    id_of[book["rank"].to_numpy(np.int64)] = book["id"].to_numpy(np.int64)
    sizes = sorted((r["part"], r["n"]) for r in stored.groupBy("part").agg(F.sum("n_values").alias("n")).collect())
    before, total = {}, 0
    for part, n in sizes:
        before[part] = total
        total += n
    shared = spark.sparkContext.broadcast((id_of, before))

    def run(batches):
        id_of, before = shared.value
        for b in batches:
            for part, first, block in zip(*(b.column(c).to_pylist() for c in range(3))):
                docs, lengths, values = read_block(block)
                ids = id_of[values]
                end = np.cumsum(lengths, dtype=np.int64)
                raw, size = ids.tobytes(), 4
                cuts = list(zip((end - lengths).tolist(), end.tolist()))
                cols = [pa.array(docs, pa.int64()), pa.array(before[part] + first + end - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(raw[s * size:e * size]) for s, e in cuts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return stored.select("part", "start_in_part", "block").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
