import hashlib
import random
import zlib

import pytest

from tiffin.llm import periodic
from tiffin.llm.common import table


def brute(w):
    """Every run, by trying each lag on the whole text."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            b = i
            while i < n and w[i] == w[i - q]:
                i += 1
            s, e = b - q, i
            if e - s >= max(12, 2 * q) and not any(all(w[k] == w[k - p] for k in range(s + p, e)) for p in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_text(rng):
    letters, n = ("ab" if rng.random() < .5 else "abc"), rng.randint(0, 90)
    pick = lambda k: "".join(rng.choice(letters) for _ in range(k))
    kind = rng.randint(0, 4)
    if kind == 0:
        s = pick(n)
    elif kind == 1:
        s = (pick(rng.randint(1, 30)) * 90)[:n]
    elif kind == 2:
        s = ""
        while len(s) < n:
            s += pick(rng.randint(1, 8)) * rng.randint(1, 6)
    elif kind == 3:
        a, s = "a", "ab"
        while len(s) < n:
            a, s = s, s + a
    else:
        u, s = "a" * rng.randint(1, 8) + "b", ""
        while len(s) < n:
            s += u if rng.random() < .7 else u[1:] + "c"
    return [c.encode() for c in s]


def expected(words):
    runs = brute(words)
    drop = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in drop)).hexdigest())


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        texts = [random_text(rng) for _ in range(rng.randint(1, 20))]
        assert [r[:7] for r in periodic.describe(texts)] == [expected(t) for t in texts]


def test_texts_beside_each_other_do_not_touch(monkeypatch):
    monkeypatch.setattr(periodic, "TOGETHER", 40)
    texts = [[b"a"] * 20, [b"a"] * 20, [b"a"] * 11, [], [b"a", b"b"] * 30, [b"b", b"a"] * 5]
    assert [r[:7] for r in periodic.describe(texts)] == [expected(t) for t in texts]


@pytest.mark.parametrize("unit", [[b"a"], [b"a"] * 6 + [b"b"], [b"w%d" % k for k in range(9000)]])
def test_long_repetition_is_not_quadratic(unit):
    words = (unit * 60_000)[:60_000]
    (n, start, length, period, *_), = periodic.describe([words])
    assert (n, start, length, period) == (1, 0, 60_000, len(unit))


def test_rewriting():
    words = [b"w%d" % k for k in range(50)]
    changed = 0
    for i in range(300):
        h = zlib.crc32(str(i).encode())
        got = periodic.periodic_tail(words, i)
        if h % 10:
            assert got == words
            continue
        changed += 1
        a, g = h // 10 % 50, h // 10
        p = 1 + (50 - a) // (3 + g % 8)
        assert got == words[:a] + [words[a + (k - a) % p] for k in range(a, 50)]
    assert changed > 10 and periodic.periodic_tail([], 4) == [] and periodic.periodic_tail(words, None) == words


def test_query_matches_brute_force(spark, sf):
    from tiffin.llm.queries import QUERIES
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    assert len(got) == len(docs)
    checked = 0
    for r in docs:
        words = periodic.periodic_tail((r["text"] or "").encode().split(), r["doc_id"])
        if len(words) <= 2500:                       # brute force is quadratic
            assert got[r["doc_id"]] == expected(words), r["doc_id"]
            checked += 1
    assert checked > 150 and any(v[0] for v in got.values())


def test_odd_rows(spark, nasty, empty):
    rows = periodic.find_runs(nasty, with_runs=True, with_text=True).collect()
    assert len(rows) == nasty.count()
    nothing = hashlib.sha256(b"").hexdigest()
    by_id = {r["doc_id"]: r for r in rows}
    for i in (3, 4, 5):
        assert tuple(by_id[i])[1:] == (0, None, None, None, None, nothing, nothing, [], "")
    # Words 0 to 29,999 in a pattern of two: every 2 * 977 * 13 words it starts again.
    assert by_id[9]["n_runs"] >= 1 and by_id[9]["period"] == 2 * 977 * 13 and by_id[9]["length"] == 60_000
    assert None in by_id and by_id[11]["n_runs"] == 0
    assert periodic.find_runs(empty).count() == 0
