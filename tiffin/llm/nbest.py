"""N-best segmentation of whole texts with the pieces of a SentencePiece model, and decoding.

A path's score is the sum of the scores of its pieces: those of the model, or,
for a model whose scores are the ranks of merges and so say nothing about whole
paths, the log-frequencies of its pieces in a corpus (``piece_counts``).
The best segmentations are the paths of highest total score through the lattice
of pieces: a forward Viterbi pass gives every position the score of its best
prefix, and an A* search from the end uses these scores as an exact heuristic,
so paths leave the agenda in order of their true score.

No piece of such a model runs across the start of a word (a space, or a line
break, which no piece holds), so the lattice of a text is a chain of small
lattices. Each distinct small lattice is solved once per worker: the Viterbi
passes run over many of them at a time, and A* runs only in those that can
change one of the N best paths of the text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SPACE_MARK = "▁"
#: Score of a character without a piece, below the worst piece; it is spelled in byte pieces.
UNKNOWN_PENALTY = 10.0
#: Distinct words remembered by a worker before its memory is emptied; texts handled at once; characters of one Viterbi pass.
REMEMBERED, GROUP, PASS_CHARS = 700_000, 512, 100_000
#: Scores at or below this mark pieces that the model keeps out of segmentations.
UNUSED_SCORE = -1e8
#: What a piece that the corpus lacks counts as; log-frequencies are rounded to steps of this size, so sums of scores are exact.
UNSEEN, SCORE_STEP = 0.5, 2.0 ** -16
#: Distinct words that a task holds with their counts, and of these how many the library encodes at once.
COUNTED, ENCODED = 500_000, 8192
#: Words whose n best paths a worker keeps.
PATHS = 25_000

_U = np.uint64


@dataclass
class Pieces:
    """What a segmentation needs of a model: pieces with scores, byte pieces, and what each id decodes to."""

    ids: dict[str, int]
    scores: np.ndarray          # by id
    byte_id: list[int]          # id of the piece of each byte value
    text: list[bytes]           # by id
    unknown: float

    @classmethod
    def load(cls, path: str, counts: dict[int, int] | None = None) -> "Pieces":
        """The model's pieces, with their scores or, if given, the log-frequencies by ``counts`` (piece id to count)."""
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        scores = np.array([sp.get_score(i) for i in range(n)])
        ids, text, byte_id = {}, [b""] * n, [sp.unk_id()] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_id[int(piece[3:5], 16)] = i
                text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ids[piece] = i
                text[i] = piece.replace(SPACE_MARK, " ").encode()
        if counts is not None:
            n_of = np.array([counts.get(i, 0) + UNSEEN for i in range(n)])
            scores = np.round(np.log(n_of / n_of[list(ids.values())].sum()) / SCORE_STEP) * SCORE_STEP
        usable = [scores[i] for i in ids.values() if scores[i] > UNUSED_SCORE]
        return cls(ids, scores, byte_id, text, min(usable) - UNKNOWN_PENALTY)

    def __post_init__(self) -> None:
        inside = any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.ids)
        if inside or any("\n" in p for p in self.ids):
            raise ValueError("pieces of this model run across word starts or line breaks")
        self.longest = max(map(len, self.ids))
        # Tells models apart: everything a segmentation depends on.
        whole = hashlib.sha256(np.ascontiguousarray(self.scores).tobytes())
        whole.update(repr((sorted(self.ids.items()), self.byte_id, self.unknown)).encode("utf-8", "surrogatepass"))
        self.digest = whole.hexdigest()

    def decode(self, ids: list[int]) -> str:
        """Text of piece ids; the space put before the text when encoding goes."""
        out = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out

    def spelled(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")]


_CHUNK = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+|\n")


def chunks(text: str) -> list[str]:
    """The independent lattices of a text, in order: ``_CHUNK`` finds them; in texts without space runs, marks or a space first, so does a split."""
    if text and "  " not in text and SPACE_MARK not in text and text[0] != " ":
        return list(filter(None, (SPACE_MARK + text.replace(" ", " " + SPACE_MARK).replace("\n", " \n ")).split(" ")))
    return _CHUNK.findall(SPACE_MARK + text.replace(" ", SPACE_MARK)) if text else []


def count_pieces(texts: Iterable[str], sp) -> np.ndarray:
    """How often the library's encoder ``sp`` uses each piece over whole texts; of words and their ids no more than ``COUNTED``, ``ENCODED`` are held."""
    total, words = np.zeros(sp.get_piece_size(), np.int64), Counter()

    def flush() -> None:
        # The library puts a space mark before a text; a line break before it keeps a chunk apart from that one.
        for part in batched(words.items(), ENCODED):
            marked = [w[0] == SPACE_MARK and len(w) > 1 for w, _ in part]
            bare = [(w[1:] if m else "\n" + w).replace(SPACE_MARK, " ") for (w, _), m in zip(part, marked)]
            ids = [i if m else i[2:] for i, m in zip(sp.encode(bare, num_threads=1), marked)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            times = np.repeat(np.fromiter((n for _, n in part), np.int64, len(part)), size)
            np.add.at(total, np.fromiter(chain.from_iterable(ids), np.int64, len(times)), times)
        words.clear()

    for text in texts:
        words.update(chunks(text))
        if len(words) > COUNTED:
            flush()
    flush()
    return total


def piece_counts(docs: DataFrame, model_path: str, text_col: str = "text") -> dict[int, int]:
    """How often the library's own encoder uses each piece over all whole texts, null ones aside.

    Pieces keep to the lattices of ``chunks``, so each distinct one of a task is
    encoded once, or once per ``COUNTED``. One row per piece, at most the model's
    size, reaches the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        from sentencepiece import SentencePieceProcessor
        texts = (t for b in batches for lo in range(0, b.num_rows, GROUP) for t in b.column(0).slice(lo, GROUP).to_pylist())
        total = count_pieces(texts, SentencePieceProcessor(model_file=model_path))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["piece", "n"])

    rows = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL").mapInArrow(run, "piece long, n long") \
        .groupBy("piece").agg(F.sum("n").alias("n"))
    return {r["piece"]: r["n"] for r in rows.collect()}


# ------------------------------------------------------------------ one lattice: Viterbi forward, A* backward
def edges(word: str, pieces: Pieces) -> list[list[tuple[int, tuple[int, ...], float]]]:
    """Per end position: (start, ids, score) of the pieces that end there, shortest first."""
    out: list[list] = [[] for _ in range(len(word) + 1)]
    for start, char in enumerate(word):
        if char not in pieces.ids:
            out[start + 1].append((start, tuple(pieces.spelled(char)), pieces.unknown))
        for end in range(start + 1, min(start + pieces.longest, len(word)) + 1):
            i = pieces.ids.get(word[start:end])
            if i is not None:
                out[end].append((start, (i,), float(pieces.scores[i])))
    return out


def best_paths(word: str, pieces: Pieces, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` segmentations of highest score (fewer if there are fewer), best first.

    Of equal scores the path found first stays first.
    """
    ends = edges(word, pieces)
    ahead = [0.0] + [0.0] * len(word)   # best score of a path from the start: the exact heuristic
    for end in range(1, len(word) + 1):
        ahead[end] = max(ahead[start] + score for start, _, score in ends[end])
    # Of equal scores the place nearest the start goes first, so ties are followed to their end one by one.
    out, agenda, order = [], [(-ahead[-1], len(word), 0, 0.0, ())], 1
    while agenda and len(out) < n:
        _, at, _, behind, tail = heapq.heappop(agenda)
        if at == 0:
            ids: list[int] = []
            while tail:
                ids += tail[0]
                tail = tail[1]
            out.append((behind, tuple(ids)))
            continue
        for start, ids_, score in reversed(ends[at]):
            heapq.heappush(agenda, (-(ahead[start] + score + behind), start, order, behind + score, (ids_, tail)))
            order += 1
    return out


# ------------------------------------------------------------------ many lattices: Viterbi in numpy
class Memory(dict):
    """Word -> number, with the best path, its score and the loss of the second-best path by number."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.forget()
        prefixes: dict[int, int] = {}
        for piece, i in pieces.ids.items():
            h = 0
            for k, c in enumerate(piece):
                h = self._roll(h, ord(c))
                prefixes.setdefault(h, -1)
            prefixes[h] = i
        self.prefix = np.array([0] + list(prefixes), _U)            # number 0 stands for no prefix
        self.piece = np.array([-1] + list(prefixes.values()), np.int64)
        self.slot_bits = max(16, (4 * len(prefixes)).bit_length())  # a quarter to an eighth of the slots is taken
        self.slots = np.zeros(1 << self.slot_bits, np.int32)
        for number, h in enumerate(prefixes, 1):
            at = h >> 64 - self.slot_bits
            while self.slots[at]:
                at = (at + 1) % len(self.slots)
            self.slots[at] = number

    def forget(self) -> None:
        """Empty the memory of words; the prefixes of the pieces stay."""
        self.clear()
        self.new: list[str] = []
        self.flat, self.offsets = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.score, self.loss = np.empty(0), np.empty(0)
        self.paths: dict[tuple[str, int], list] = {}

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the prefixes with these hashes, 0 for none: open addressing, all lookups at once."""
        at = (h >> _U(64 - self.slot_bits)).astype(np.int64)
        out = self.slots[at]
        wrong = np.flatnonzero((out > 0) & (self.prefix[out] != h))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % len(self.slots)
            out[wrong] = self.slots[at[wrong]]
            wrong = wrong[(out[wrong] > 0) & (self.prefix[out[wrong]] != h[wrong])]
        return out

    @staticmethod
    def _roll(h: int, c: int) -> int:
        return ((h ^ c) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number

    def learn(self) -> None:
        new, self.new = self.new, []
        lo = 0
        while lo < len(new):
            hi, chars = lo, 0
            while hi < len(new) and (hi == lo or chars + len(new[hi]) <= PASS_CHARS):
                chars += len(new[hi])
                hi += 1
            self._solve(new[lo:hi])
            lo = hi

    def _solve(self, words: list[str]) -> None:
        p = self.pieces
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))   # longest first: the words still open are a prefix
        size = np.array([len(words[i]) for i in order], np.int64)
        code = np.frombuffer("\0".join([words[i] for i in order] + [""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
        base = np.concatenate([[0], np.cumsum(size + 1)])[:-1]            # a word of n characters has n + 1 places
        left = np.repeat(base + size, size + 1) - np.arange(len(code))    # characters up to the word's end
        longest = int(min(p.longest, size.max()))
        piece = np.full((longest + 1, len(code)), -1, np.int64)
        at, h = np.flatnonzero(left > 0), np.zeros(len(code), _U)
        for k in range(1, longest + 1):
            at = at[left[at] >= k]
            if not len(at):
                break
            h[at] = (h[at] ^ code[at + k - 1]) * _U(0x9E3779B97F4A7C15) + _U(0x632BE59BD9B4E019)
            found = self._find(h[at])
            hit = found > 0
            at, found = at[hit], found[hit]
            piece[k, at] = self.piece[found]
        longest = max([1, *np.flatnonzero((piece >= 0).any(axis=1))])     # of the pieces met here
        piece = piece[:longest + 1]
        score = np.where(piece >= 0, p.scores[np.maximum(piece, 0)], -np.inf)
        score[1, (left > 0) & (piece[1] < 0)] = p.unknown
        ahead, behind = np.full(len(code), -np.inf), np.full(len(code), -np.inf)
        ahead[base], behind[base + size] = 0.0, 0.0
        step = np.zeros(len(code), np.int64)
        for j in range(1, int(size.max()) + 1):
            n = int(np.searchsorted(-size, -j, side="right"))
            here, top, by = base[:n] + j, np.full(n, -np.inf), np.zeros(n, np.int64)
            for k in range(1, min(j, longest) + 1):
                v = ahead[here - k] + score[k, here - k]
                better = v >= top
                top, by = np.where(better, v, top), np.where(better & (v > -np.inf), k, by)
            ahead[here], step[here] = top, by
            back = base[:n] + size[:n] - j
            top = np.full(n, -np.inf)
            for k in range(1, min(j, longest) + 1):
                top = np.maximum(top, score[k, back] + behind[back + k])
            behind[back] = top
        # Best path, from the end; then the best path through any piece that is not on it.
        through = np.full(len(code), -np.inf)
        on = np.zeros((longest + 1, len(code)), bool)
        place, which, taken = base + size, np.arange(len(words)), []
        while len(which):
            k = step[place]
            place = place - k
            on[k, place] = True
            taken.append((which, place, k))
            live = place > base[which]
            which, place = which[live], place[live]
        for k in range(1, longest + 1):
            v = ahead[:len(code) - k] + score[k, :len(code) - k] + behind[k:]
            v[on[k, :len(code) - k] | (left[:len(code) - k] < k)] = -np.inf
            through[:len(code) - k] = np.maximum(through[:len(code) - k], v)
        second = np.maximum.reduceat(through, base)
        which, place, k = (np.concatenate(x) for x in zip(*taken))
        sort = np.lexsort((place, which))
        which, place, k = which[sort], place[sort], k[sort]
        ids = piece[k, place]
        odd = np.flatnonzero(ids < 0)
        if len(odd):     # characters without a piece: several byte pieces each
            spelled = [p.spelled(chr(int(code[i]))) for i in place[odd]]
            count = np.ones(len(ids), np.int64)
            count[odd] = [len(s) for s in spelled]
            which, wide = np.repeat(which, count), np.repeat(ids, count)
            wide[wide < 0] = np.concatenate(spelled)
            ids = wide
        # Back from longest-first to the order in which the words were numbered.
        order = np.array(order)
        rank = order[which]
        sort = np.argsort(rank, kind="stable")
        count = np.bincount(rank, minlength=len(words))
        mine = np.empty(len(words), np.int64)
        mine[order] = np.arange(len(words))
        self.flat = np.concatenate([self.flat, ids[sort].astype(np.int32)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(count)])
        total = ahead[base + size]
        self.score = np.concatenate([self.score, total[mine]])
        self.loss = np.concatenate([self.loss, (total - second)[mine]])

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, end of each word in them)."""
        first, size = self.offsets[numbers], self.offsets[numbers + 1] - self.offsets[numbers]
        end = np.cumsum(size)
        return self.flat[np.repeat(first - end + size, size) + np.arange(end[-1] if len(end) else 0)], end

    def alternatives(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best paths of a word; the first is the one the Viterbi pass chose."""
        if (word, n) not in self.paths:
            if len(self.paths) > PATHS:
                self.paths.clear()
            number = self[word]
            mine = tuple(self.flat[self.offsets[number]:self.offsets[number + 1]].tolist())
            found = best_paths(word, self.pieces, n + 1)
            self.paths[word, n] = ([(float(self.score[number]), mine)] + [f for f in found if f[1] != mine])[:n]
        return self.paths[word, n]


def segment(words: list[str], numbers: np.ndarray, memory: Memory, n: int) -> list[tuple[float, np.ndarray]]:
    """The ``n`` best segmentations of a text from those of its words, best first.

    Changing one word alone costs its loss. The n - 1 words of least loss give
    n - 1 paths already, so no other word can differ in a path among the n best.
    """
    if not words:
        return [(0.0, np.empty(0, np.int32))]
    ids, end = memory.ids(numbers)
    best = float(memory.score[numbers].sum())
    loss = memory.loss[numbers]
    pick = [int(i) for i in np.sort(np.argsort(loss, kind="stable")[:n - 1]) if np.isfinite(loss[i])] if n > 1 else []
    options = [memory.alternatives(words[i], n) for i in pick]
    agenda, seen, out = [(0.0, (0,) * len(pick))], {(0,) * len(pick)}, []
    while agenda and len(out) < n:
        cost, choice = heapq.heappop(agenda)
        parts, at = [], 0
        for i, o, c in zip(pick, options, choice):
            if c:
                parts += [ids[at:end[i - 1] if i else 0], np.array(o[c][1], np.int32)]
                at = end[i]
        out.append((best - cost, np.concatenate(parts + [ids[at:]]) if parts else ids))
        for x, o in enumerate(options):
            c = choice[x] + 1
            nxt = choice[:x] + (c,) + choice[x + 1:]
            if c < len(o) and nxt not in seen:
                seen.add(nxt)
                heapq.heappush(agenda, (cost + o[c - 1][0] - o[c][0], nxt))
    return out


# ------------------------------------------------------------------ operator
_MEMORY: dict[str, Memory] = {}


def _memory(pieces: Pieces) -> Memory:
    """The worker's memory for a model."""
    key = pieces.digest
    if key not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[key] = Memory(pieces)
    return _MEMORY[key]


def encode(docs: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = True, counts: dict[int, int] | None = None, remembered: int = REMEMBERED, keep_words: bool = True) -> DataFrame:
    """Per document: id, n_pieces, ids_crc32 and round_trip of the best path, and the n best as an array.

    ``best`` holds (score, n_pieces, ids_crc32) of each path, best first, and
    ``ids`` the ids of the best. Whole texts; null and empty texts have one
    empty path. ``round_trip`` says whether decoding gives the text back: it does
    unless the text holds the space mark itself. Crc32 is over the ids as
    little-endian unsigned 32-bit integers. Scores are the model's, or by
    ``counts`` (``piece_counts``). Workers remember ``remembered`` words, from one
    task to the next unless ``keep_words`` is false: then a worker that goes on to
    other work holds none. Results do not depend on either. Other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Pieces.load(model_path, counts))

    def run(batches: Iterator[pa.RecordBatch]):
        memory = _memory(shared.value)
        try:
            yield from work(batches, memory)
        finally:
            if not keep_words:
                memory.forget()

    def work(batches: Iterator[pa.RecordBatch], memory: Memory):
        pieces = memory.pieces
        for whole in batches:
            for lo in range(0, whole.num_rows, GROUP):
                b = whole.slice(lo, GROUP)
                if len(memory) > remembered:
                    memory.forget()
                texts = [t or "" for t in b.column(1).to_pylist()]
                words = [chunks(t) for t in texts]
                numbers = [np.fromiter(map(memory.__getitem__, w), np.int64, len(w)) for w in words]
                memory.learn()
                size, crc, same, best, ids = [], [], [], [], []
                for t, w, k in zip(texts, words, numbers):
                    paths = segment(w, k, memory, n)
                    rows = [{"score": s, "n_pieces": len(i), "ids_crc32": zlib.crc32(i.astype("<u4").tobytes())} for s, i in paths]
                    best.append(rows)
                    size.append(rows[0]["n_pieces"]), crc.append(rows[0]["ids_crc32"])
                    same.append(pieces.decode(paths[0][1].tolist()) == t)
                    ids.append(paths[0][1])
                cols = [b.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()),
                        pa.array(best, pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64())])))]
                names = ["doc_id", "n_pieces", "ids_crc32", "round_trip", "best"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(i) for i in ids]), pa.int32()),
                                                         pa.array(np.concatenate(ids), pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean, best array<struct<score: double, n_pieces: long, ids_crc32: long>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def decode(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of piece ids; null ids give a null text."""
    shared = tokens.sparkSession.sparkContext.broadcast(Pieces.load(model_path))

    def run(batches):
        for b in batches:
            text = [None if i is None else shared.value.decode(i) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(text, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
