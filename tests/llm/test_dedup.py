import itertools
import random

import numpy as np
import pytest

from tiffin.llm import metricjoin, minhash
from tiffin.llm.common import connected_components, table


def components(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def shingle_set(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return frozenset()
    k = min(width, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def brute_documents(rows, percent, width):
    sets = {i: shingle_set(t, width) for i, t in rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, components(sets, links)


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(6, 30)] + [(3, 3), (None, 4), (7, 5), (7, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 5 for i in range(5, 30)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 7, 12, 60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 12, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((n, (" " if rng.random() < 0.7 else " \n").join(words)))
            n += 1
    return rows


@pytest.mark.parametrize("percent,width", [(85, 3), (80, 5)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, percent, width):
    monkeypatch.setattr(minhash, "BLOCK", 5)      # several blocks per bucket and component
    rows = near_copies()
    sizes, label = brute_documents(rows, percent, width)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, width=width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == \
        {i: (sizes[i], label[i], label[i] == i) for i in sizes}
    assert len(set(label.values())) < len(rows)


def test_near_duplicates_edge_cases(nasty, empty):
    got = [tuple(r) for r in minhash.near_duplicates(nasty, percent=85, width=3).collect()]
    assert len(got) == nasty.count()
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1:])
    assert by[1] == [(11, 1, True)] or by[1][0][1:] == (1, True)
    assert all(x[1:] == (1, False) for x in by[2]) and len(by[2]) == 2
    assert by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)]   # empty sets do not link
    assert by[None] == [(1, None, True)] and by[6] == [(1, 6, True)]
    assert minhash.near_duplicates(empty).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.9):
        errors = []
        for _ in range(60):
            n = 2000
            common, a, b = (rng.integers(0, (1 << 64) - 1, k, dtype=np.uint64) for k in (int(n * share), n - int(n * share), n - int(n * share)))
            x, y = np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            est, used = minhash.estimate(minhash.registers(x), len(x), minhash.registers(y)[None], np.array([len(y)]))
            errors.append(est[0] - true)
        assert abs(np.mean(errors)) < 0.03 and used[0] == minhash.BUCKETS


def brute_vectors(rows, least=0.9):
    ok = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None}
    links = [(a, b) for a, b in itertools.combinations(ok, 2) if len(ok[a]) == len(ok[b])
             and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= least]
    degree = {i: 0 for i, _ in rows if i is not None}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return degree, components(degree, links)


@pytest.mark.parametrize("cell,block", [(4096, 4096), (25, 7)])
def test_metric_join_matches_brute_force(spark, cell, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    rows = [(i, [float(x) for x in base[i % 30] * rng.uniform(0.5, 2) + rng.normal(size=8) * rng.choice([0, 0.1, 0.4])]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, []), (304, [0.0] * 8), (305, [float("nan")] + [1.0] * 7),
             (306, [float("inf")] + [1.0] * 7), (307, [None] + [1.0] * 7), (308, [1.0, 0.0]), (309, [2.0, 0.1])]
    degree, label = brute_vectors(rows)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, size string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in metricjoin.near_duplicates(df, cell=cell, block=block).collect()}
    assert got == {i: (degree[i], label[i], label[i] == i) for i in degree}
    assert got[309][1] == 308


def test_metric_join_edge_cases(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in metricjoin.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]
    assert metricjoin.near_duplicates(df.limit(0)).count() == 0


def test_queries_on_given_tables(spark, sf):
    from tiffin.llm.queries import QUERIES
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    sizes, label = brute_documents(docs, 85, 3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op6_near_duplicates"](spark, sf).collect()}
    assert got == {i: (sizes[i], label[i]) for i in sizes}


def test_slack_covers_single_precision_at_any_width():
    import numpy as np
    from tiffin.llm.metricjoin import slack, unit
    rng = np.random.default_rng(5)
    for width in (1, 3, 64, 1000, 30_000):
        x, y = unit(rng.random((40, width)) + 0.1), unit(rng.random((40, width)) + 0.1)    # one sign: errors add up
        error = np.abs(x.astype(np.float32) @ y.astype(np.float32).T - x @ y.T).max()
        assert error <= slack(width) / 2


def test_texts_reach_the_workers_in_small_batches(spark, monkeypatch):
    from tiffin.llm.common import BATCH
    from pyspark.sql import functions as F

    def watched(real):
        def made(*args):
            work = real(*args)

            def run(batches):
                def seen():
                    for b in batches:
                        assert b.nbytes <= 6 << 20, f"a batch of {b.nbytes} bytes"
                        yield b
                return work(seen())
            return run
        return made

    for name in ("_sketch", "_sets"):
        monkeypatch.setattr(minhash, name, watched(getattr(minhash, name)))
    # 24 MB of texts in one task; each text comes twice but for its last word.
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.expr(
        "concat_ws(' ', transform(sequence(1, 800), x -> hex(hash(x, id div 2))), string(id % 2))").alias("text"))
    before = spark.conf.get(BATCH[0], None)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: i - i % 2 for i in range(3000)}
    assert spark.conf.get(BATCH[0], None) == before
