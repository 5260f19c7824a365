"""Periodic runs of the words of a text, found online by a sparse diagonal dynamic programme.

A lag q is a diagonal: it is active at word i while word i equals word i - q, and
its match length grows by one with every such word. When it ends with a match of
q words or more and a stretch of ``SHORTEST`` words or more, the stretch is a run
and is emitted at once.

Sparse: of the earlier occurrences of a word only those count that can belong to
a run. A run of period q needs at least max(q, SHORTEST - q) matching words, so
lags fall into classes (1 to 11, 12 to 23, 24 to 47, ...), and in the class whose
runs have k matching words at least, two occurrences are the same only if the
k - 1 words before them are the same too. Texts without repetition have next to
no occurrences left, and places without any are not visited.

Bounded: a diagonal q that begins while a smaller lag p is active, and no earlier
than p, has the period p too when it ends before p does, so it is not started.
What it misses if p ends first is found then: every end of a diagonal looks again
at all occurrences in reach and extends them backwards.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words of the shortest run; a run has two periods at least besides.
SHORTEST = 12
#: Words looked at together: texts are gathered up to this many, a longer one is alone.
TOGETHER = 1 << 18


def periodic_tail(words: list, doc_id: int | None) -> list:
    """The given rewriting of a text: for some ids every word from one on is replaced by the one p words before it."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


# ------------------------------------------------------------------ earlier occurrences
def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of distinct pairs; exact as long as numbers stay below 2^31."""
    return pd.factorize(left * np.int64(1 << 31) + right)[0].astype(np.int64)


def occurrences(ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, dict[int, int]]]:
    """Per class of lags (k, lowest lag, end of lags, {place: place of the previous occurrence in context}).

    ``ids`` are the words of several texts side by side, ``first`` the place where
    the text of each word begins. A place is listed if the k words that end there
    end at an earlier place of its text, less than 2k before it, too.
    """
    place = np.arange(len(ids))
    two = np.full(len(ids), -1, np.int64)
    at = place[place - first >= 1]
    two[at] = _pairs(ids[at - 1], ids[at])
    four = np.full(len(ids), -1, np.int64)
    at = place[place - first >= 3]
    four[at] = _pairs(two[at - 2], two[at])
    at = place[place - first >= 5]
    gram = _pairs(four[at - 2], two[at])
    found, k = [], SHORTEST // 2
    while len(at):
        # Same words in context, same text, in order: neighbours are an occurrence and the one before it.
        order = np.lexsort((at, gram))
        a, g = at[order], gram[order]
        same = (g[1:] == g[:-1]) & (first[a[1:]] == first[a[:-1]])
        if not same.any():
            break
        near = same & (a[1:] - a[:-1] < 2 * k)
        found.append((k, 1 if k == SHORTEST // 2 else k, 2 * k, dict(zip(a[1:][near].tolist(), a[:-1][near].tolist()))))
        # A run of a longer class has 2k matching words: both halves of 2k words must occur again or before.
        twice = np.zeros(len(a), bool)
        twice[1:] |= same
        twice[:-1] |= same
        number = np.full(len(ids), -1, np.int64)
        number[a[twice]] = g[twice]
        at = np.sort(a[twice])
        at = at[at - first[at] >= 2 * k - 1]
        at = at[number[at - k] >= 0]
        gram = _pairs(number[at - k], number[at]) if len(at) else at
        k *= 2
    return found


def runs(ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of every run of the texts side by side, in the order in which they end."""
    classes = occurrences(ids, first)
    if not classes:
        return
    word = ids.tolist()
    active: dict[int, int] = {}                       # lag -> first matching place; smaller lags begin later
    last = -1
    for i in sorted(set().union(*(prev for *_, prev in classes))):
        since = i + 1                                 # first matching place of the diagonals that end here
        if i != last + 1:                             # nothing occurs between: every diagonal has ended after the last place
            for q, begin in active.items():
                if last + 1 - begin >= q and last + 1 - begin + q >= SHORTEST:
                    yield begin - q, last + 1, q
            active.clear()
        else:
            for q in [q for q in active if word[i] != word[i - q]]:
                begin = active.pop(q)
                since = min(since, begin)
                if i - begin >= q and i - begin + q >= SHORTEST:
                    yield begin - q, i, q
        last = i
        for k, lowest, end, prev in classes:
            j = prev.get(i, -1)
            if j < 0:
                continue
            # Diagonals first seen here begin at i - k + 1; those that had to wait for one that ends here begin earlier.
            earliest = min(since, i - k + 1)
            longest = end
            for p, begin in active.items():
                if p < longest and begin <= earliest:
                    longest = p
            while j >= 0 and i - j < longest:
                q = i - j
                if q >= lowest and q not in active:
                    begin = _back(word, ids, q, i - k + 1, max(int(first[i]) + q, earliest - 1))
                    # One that begins still earlier was seen then, and waits for another.
                    if begin >= earliest and not any(p < q and b <= begin for p, b in active.items()):
                        active[q] = begin
                        if begin == earliest:
                            break                     # the longer ones begin no earlier
                j = prev.get(j, -1)
    for q, begin in active.items():
        if last + 1 - begin >= q and last + 1 - begin + q >= SHORTEST:
            yield begin - q, last + 1, q


def _back(word: list[int], ids: np.ndarray, q: int, begin: int, least: int) -> int:
    """First place of the match of lag q that holds at ``begin``, looking back to ``least`` only."""
    for _ in range(8):
        if begin <= least or word[begin - 1] != word[begin - 1 - q]:
            return begin
        begin -= 1
    step = 64
    while begin > least:
        lo = max(least, begin - step)
        other = np.flatnonzero(ids[lo:begin] != ids[lo - q:begin - q])
        if len(other):
            return lo + int(other[-1]) + 1
        begin, step = lo, 4 * step
    return begin


# ------------------------------------------------------------------ texts
def _described(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    """Columns of one text from its runs (start, end, period)."""
    found = sorted(found, key=lambda r: (r[0], r[2]))
    if not found:
        kept = words
        best = (None, None, None, None)
    else:
        drop = np.zeros(len(words), bool)
        for s, e, q in found:
            drop[s + q:e] = True
        kept = [words[k] for k in np.flatnonzero(~drop).tolist()]
        s, e, q = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]))
        best = (s, e - s, q, 1000 * (e - s) // q)
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    return (len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), found, kept)


def describe(texts: list[list[bytes]]) -> list[tuple]:
    """Per text n_runs, the longest run's four columns, both digests, runs (start, end, period) and kept words."""
    out: list[tuple] = []
    lo = 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= TOGETHER):
            held += len(texts[hi])
            hi += 1
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for t in texts[lo:hi] for w in t), np.int64, held)
        size = np.array([len(t) for t in texts[lo:hi]], np.int64)
        begin = np.cumsum(size) - size
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(lo, hi)]
        for s, e, q in runs(ids, np.repeat(begin, size)):
            k = int(np.searchsorted(begin, s, "right")) - 1
            found[k].append((s - int(begin[k]), e - int(begin[k]), q))
        out += [_described(t, f) for t, f in zip(texts[lo:hi], found)]
        lo = hi
    return out


_SHAPE = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite=None, with_runs: bool = False,
              with_text: bool = False) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256 and collapsed_sha256 per document.

    Words are separated by white space (space and tab to carriage return); positions count words from 0. ``rewrite(words,
    doc_id)`` may change the words first. ``with_runs`` adds the runs as (start, length, period), ``with_text`` the text
    without the repeated part of its runs. A null, empty or blank text has no words and no runs (digests of the empty
    string); rows keep a null or repeated id as it is; other columns are not read.
    """
    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            words = [(t or "").encode().split() for t in b.column(1).to_pylist()]
            if rewrite is not None:
                words = [rewrite(w, i) for w, i in zip(words, ids)]
            rows = describe(words)
            cols = [pa.array(ids, pa.int64())] + [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            cols += [pa.array([r[k] for r in rows], pa.string()) for k in (5, 6)]
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            if with_runs:
                kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
                cols.append(pa.array([[{"start": s, "length": e - s, "period": q} for s, e, q in r[7]] for r in rows], kind))
                names.append("runs")
            if with_text:
                cols.append(pa.array([b" ".join(r[8]).decode() for r in rows], pa.string()))
                names.append("collapsed")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    shape = _SHAPE + (", runs array<struct<start long, length long, period long>>" if with_runs else "") + (", collapsed string" if with_text else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, shape)
