"""Token counts of whole texts by a map-side lookup of two tiers; no pre-token is ever shuffled.

First tier: a compact open-addressing table of the frequent pre-tokens (up to 16
bytes as two integers, so a hit is exact) with the number of tokens of each. It
is filled from counts over the whole corpus: every task keeps a bounded summary
of its pre-tokens, and summaries, not pre-tokens, are merged. The table only
decides how fast a pre-token is counted, never how.

Second tier: whatever misses is encoded by the library, many pre-tokens at a
time, and remembered by the worker.

Pre-tokens are cut here only for tokenizer files that state the rule of
``RULE``; with any other file each text goes to its library whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SPACE

#: The rule of the tokenizer file (lower-cased text): contractions, letter runs, single digits, other runs.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Entries of the broadcast table; two slots of 17 bytes each.
TABLE = 1 << 16
#: Pre-tokens a worker remembers before it starts anew (and keeps the old ones to take over from), and the longest of them.
REMEMBERED, LONGEST = 400_000, 256
#: Texts are looked up in slabs of about this many bytes, cut at white space.
SLAB = 1 << 20

_LETTERS = bytes(c for c in range(256) if 0x61 <= c <= 0x7A or c >= 0xDF and c != 0xF7)
_KIND = np.full(256, 3, np.uint8)                                    # 0 space, 1 letter, 2 digit, 3 other
_KIND[list(_LETTERS)] = 1
_KIND[0x30:0x3A] = 2
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
#: Bytes of Latin-1 texts that can be cut here: ASCII without NUL, and letters.
_PLAIN = bytes(range(1, 0x80)) + bytes(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_WORD = re.compile(rf"[^{SPACE}]+")
_SPACES = re.compile(rb"[\x20\x09-\x0D]")
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def cut(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the pre-tokens of lower-cased Latin-1 bytes."""
    kind = _KIND[np.frombuffer(raw, np.uint8)]
    n = len(kind)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.empty(n + 1, bool)                                    # a pre-token (or a space) begins here
    first[0] = first[n] = True
    first[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    at = raw.find(b"'")
    while at >= 0:
        # A contraction is a lone apostrophe, not part of a longer run, before one of the endings.
        if first[at] and at + 1 < n and kind[at + 1] == 1:
            tail = raw[at + 1:at + 3].decode("latin-1")
            for ending in _ENDINGS:
                if tail.startswith(ending):
                    first[at + 1] = False
                    first[at + 1 + len(ending)] = True
                    break
        at = raw.find(b"'", at + 1)
    edges = np.flatnonzero(first)
    start, length = edges[:-1], np.diff(edges)
    real = kind[start] != 0
    return start[real], length[real]


def keys(raw: bytes, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of up to 16 bytes as two little-endian integers."""
    padded = np.frombuffer(raw + bytes(16), np.uint8)
    view = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(padded) - 7,), (1,))
    return view[start] & _MASK[np.minimum(length, 8)], view[start + 8] & _MASK[np.clip(length - 8, 0, 8)]


def _mixed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    h = low * np.uint64(0x9E3779B97F4A7C15) ^ (high + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


class Table:
    """Number of tokens by pre-token key: open addressing, linear probing, half full at most."""

    def __init__(self, low: np.ndarray, high: np.ndarray, tokens: np.ndarray):
        bits = max(4, int(2 * len(low)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.low, self.high, self.tokens = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint8)
        slot, left = _mixed(low, high) & self.mask, np.arange(len(low))
        while len(left):
            free = self.tokens[slot[left]] == 0
            _, one = np.unique(slot[left], return_index=True)         # one claimant per free slot
            put = left[one[free[one]]]
            self.low[slot[put]], self.high[slot[put]], self.tokens[slot[put]] = low[put], high[put], tokens[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = slot[left] + np.uint64(1) & self.mask

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Tokens of each key, 0 where the table does not hold it."""
        out = np.zeros(len(low), np.int64)
        slot, left = _mixed(low, high) & self.mask, np.arange(len(low))
        while len(left):
            at = slot[left]
            n = self.tokens[at]
            same = (self.low[at] == low[left]) & (self.high[at] == high[left])
            out[left[same]] = n[same]
            left = left[~same & (n > 0)]
            slot[left] = slot[left] + np.uint64(1) & self.mask
        return out


class _Library:
    """What one worker knows of a tokenizer file, and the second tier."""

    def __init__(self, kind: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"               # a task has one core
        self.by_pre_token = False
        if kind == "model":
            import sentencepiece
            pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
            self.whole = lambda t: len(pieces.encode(t, num_threads=1))
            return
        from tokenizers import Tokenizer
        text = model.decode()
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = lambda t: len(self.tokenizer.encode(t, add_special_tokens=False).ids)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        rules = json.loads(text)
        suffix = rules["model"].get("end_of_word_suffix")
        self.by_pre_token = bool(suffix) and json.dumps(RULE) in json.dumps(rules.get("pre_tokenizer")) \
            and '"Lowercase"' in json.dumps(rules.get("normalizer"))
        if self.by_pre_token:
            self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def sizes(self, words: list[str]) -> np.ndarray:
        """Tokens of each distinct pre-token; each ends with its one word-end id."""
        coded = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.int64)
        ends = np.flatnonzero(self.ends_word[coded]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not end each pre-token with a word-end id")
        return np.diff(ends, prepend=0)

    def remember(self, words: list[str], count) -> dict[str, int]:
        """Tokens by word; ``count`` says those of words that the worker has not met."""
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        out, unknown = {}, []
        for w in words:
            n = self.new.get(w) or self.old.get(w)
            if n is None:
                unknown.append(w)
            else:
                out[w] = n
        for lo in range(0, len(unknown), 8192):
            part = unknown[lo:lo + 8192]
            out.update(zip(part, (int(n) for n in count(part))))
        self.new.update((w, n) for w, n in out.items() if len(w) <= LONGEST)
        return out

    def split(self, text: str) -> tuple[bytes, list[str]]:
        """The text as bytes that ``cut`` takes, and words left for the library (characters beyond Latin letters, special strings)."""
        special = any(s in text for s in self.special)
        if not special:
            try:
                raw = text.encode("latin-1")
                if not raw.translate(None, _PLAIN):
                    return text.lower().encode("latin-1"), []
            except UnicodeEncodeError:
                pass
        plain, odd = [], []
        for w in _WORD.findall(text):
            try:
                is_plain = not w.encode("latin-1").translate(None, _PLAIN) and not (special and any(s in w for s in self.special))
            except UnicodeEncodeError:
                is_plain = False
            (plain if is_plain else odd).append(w)
        return " ".join(plain).lower().encode("latin-1"), odd


_LIBRARIES: dict[tuple, _Library] = {}


def _library(kind: str, model: bytes) -> _Library:
    key = kind, len(model), zlib.crc32(model)
    if key not in _LIBRARIES:
        _LIBRARIES[key] = _Library(kind, model)
    return _LIBRARIES[key]


def _slabs(raw: bytes) -> Iterator[bytes]:
    """Parts of about ``SLAB`` bytes, cut at white space, which no pre-token crosses."""
    lo = 0
    while len(raw) - lo > SLAB:
        space = _SPACES.search(raw, lo + SLAB)
        hi = space.start() if space else len(raw)
        yield raw[lo:hi]
        lo = hi
    yield raw[lo:]


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about one slab together."""
    lo = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= SLAB:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _count(library: _Library, table: Table, texts: list[str | None]) -> np.ndarray:
    """Tokens of each text."""
    total = np.zeros(len(texts), np.int64)
    if not library.by_pre_token:
        return np.array([library.whole(t) if t else 0 for t in texts], np.int64)
    for lo, hi in _groups(texts):
        parts = [library.split(t or "") for t in texts[lo:hi]]
        odd = {w for _, words in parts for w in words}
        if odd:
            size = library.remember(list(odd), lambda ws: map(library.whole, ws))
            total[lo:hi] += [sum(map(size.__getitem__, words)) for _, words in parts]
        # Texts of a group side by side; a text longer than a slab is alone in its own slabs.
        if hi - lo == 1:
            for slab in _slabs(parts[0][0]):
                total[lo] += _lookup(library, table, slab)[1].sum()
            continue
        start, tokens = _lookup(library, table, b"\n".join(p for p, _ in parts))
        ends = np.cumsum([len(p) + 1 for p, _ in parts])
        before = np.concatenate([[0], np.cumsum(tokens)])
        total[lo:hi] += np.diff(before[np.searchsorted(start, ends)], prepend=0)
    return total


def _lookup(library: _Library, table: Table, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, tokens) of every pre-token."""
    start, length = cut(raw)
    if not len(start):
        return start, length
    tokens = table.find(*keys(raw, start, length))
    tokens[length > 16] = 0
    miss = np.flatnonzero(tokens == 0)
    if len(miss):
        words = [raw[s:e].decode("latin-1") for s, e in zip(start[miss].tolist(), (start[miss] + length[miss]).tolist())]
        size = library.remember(list(dict.fromkeys(words)), library.sizes)
        tokens[miss] = list(map(size.__getitem__, words))
    return start, tokens


# ------------------------------------------------------------------ the frequent pre-tokens
class _Summary:
    """Counts of the frequent keys of a stream in bounded memory.

    Beyond ``4 * size`` keys the ``2 * size`` most frequent stay and lose the count
    of the next one, so a key seen in more than 1 / (2 * size) of all places is
    never lost, whatever the order and however summaries are merged.
    """

    def __init__(self, size: int):
        self.size, self.low, self.high, self.n = size, np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> None:
        low, high, n = np.concatenate([self.low, low]), np.concatenate([self.high, high]), np.concatenate([self.n, n])
        _, first, group = np.unique(_mixed(low, high), return_index=True, return_inverse=True)
        self.low, self.high, self.n = low[first], high[first], np.bincount(group, n, len(first)).astype(np.int64)
        if len(first) > 4 * self.size:
            order = np.argsort(-self.n, kind="stable")
            keep = order[:2 * self.size]
            left = self.n[keep] - self.n[order[2 * self.size]]
            keep, left = keep[left > 0], left[left > 0]
            self.low, self.high, self.n = self.low[keep], self.high[keep], left

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (self.low, self.high, self.n)], names=["low", "high", "n"])


def frequent(docs: DataFrame, kind: str, model, size: int, text_col: str = "text"):
    """(low, high, n) of the ``size`` most frequent short pre-tokens, counted over all texts.

    A task returns one bounded summary; three levels of merging tasks, each holding
    one summary and the one that comes in, leave one for the driver.
    """
    def count(batches):
        library, seen = _library(kind, model.value), _Summary(size)
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in _groups(texts):
                for slab in _slabs(b"\n".join(library.split(t)[0] for t in texts[lo:hi] if t)):
                    start, length = cut(slab)
                    short = length <= 16
                    low, high = keys(slab, start[short], length[short])
                    seen.add(low, high, np.ones(len(low), np.int64))
        yield seen.batch()

    def merge(batches):
        seen = _Summary(size)
        for b in batches:
            for low, high, n in zip(*(b.column(c).to_pylist() for c in range(3))):
                seen.add(np.frombuffer(low, np.uint64), np.frombuffer(high, np.uint64), np.frombuffer(n, np.int64))
        yield seen.batch()

    shape = "low binary, high binary, n binary"
    cores = docs.sparkSession.sparkContext.defaultParallelism
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, shape)
    for tasks in dict.fromkeys((cores, max(1, int(cores ** 0.5)), 1)):
        found = found.repartition(tasks).mapInArrow(merge, shape)
    rows = found.collect()
    if not rows:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    low, high, n = (np.frombuffer(x, d) for x, d in zip(rows[0], (np.uint64, np.uint64, np.int64)))
    best = np.argsort(-n, kind="stable")[:size]
    return low[best], high[best], n[best]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text",
                 table_size: int = TABLE) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    ``tokenizer_path`` ends in .json (tokenizers) or .model (sentencepiece); begin, end and added special tokens,
    truncation and padding are off. A null text has 0 bytes and 0 tokens, as an empty one. Rows keep a null or
    repeated id as it is; other columns are not read.
    """
    kind = tokenizer_path.rsplit(".", 1)[-1]
    if kind not in ("json", "model"):
        raise ValueError(f"neither .json nor .model: {tokenizer_path}")
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    model = docs.sparkSession.sparkContext.broadcast(content)
    library = _library(kind, content)
    low = high = np.empty(0, np.uint64)
    tokens = np.empty(0, np.uint8)
    if library.by_pre_token:
        low, high, _ = frequent(docs, kind, model, table_size, text_col)
        words = [int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little") for a, b in zip(low, high)]
        if words:
            tokens = library.sizes([w.rstrip(b"\0").decode("latin-1") for w in words]).astype(np.uint8)
    table = docs.sparkSession.sparkContext.broadcast(Table(low, high, tokens))

    def run(batches):
        library = _library(kind, model.value)
        for b in batches:
            n = _count(library, table.value, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("n"), F.col(text_col).alias("text")) \
        .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
