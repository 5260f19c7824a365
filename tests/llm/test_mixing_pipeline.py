import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tiffin.llm import mixing
from tiffin.llm.common import stage, table


def brute_rates(cells, targets, budget, pull=mixing.PULL):
    """The same objective, minimised by plain projected gradient steps until nothing moves."""
    w = np.array([c[1] for c in cells], float)
    w /= w.sum()
    p = np.array([c[0] for c in cells])
    goal = budget * np.array([targets[d] for d in mixing.DOMAINS]) / sum(targets.values())
    metric = np.linalg.pinv((p * w[:, None]).T @ p)
    r = np.ones(len(cells))
    for _ in range(50_000):
        r = np.clip(r - (p @ (metric @ ((w * r) @ p - goal)) + pull * (r - 1)) / (1 + pull), 0, mixing.MAX_RATE)
    return r, (w * r) @ p


def test_rates_match_a_plain_solver(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.dirichlet([2, 1, 0.5], 60), 3)
    p[:, 0] = 1 - p[:, 1] - p[:, 2]
    tokens = rng.integers(1, 5000, 60)
    cells = stage(spark.createDataFrame([(*map(float, x), int(t)) for x, t in zip(p, tokens)], "p_high double, p_low double, p_toxic double, tokens long"), "t")
    rates = mixing.fit_rates(cells)
    got = cells.select("p_high", "p_low", "p_toxic", "tokens", rates.fold([F.col(f"p_{d}") for d in mixing.DOMAINS])["r"].alias("r")).collect()
    want, totals = brute_rates([(list(r)[:3], r["tokens"]) for r in got], mixing.TARGETS, mixing.BUDGET)
    w = np.array([r["tokens"] for r in got], float) / sum(r["tokens"] for r in got)
    mine = (w * np.array([r["r"] for r in got])) @ np.array([list(r)[:3] for r in got])
    assert np.abs(mine - totals).max() < 2e-3
    assert np.abs(np.array([r["r"] for r in got]) - want).max() < 0.01


def reached(spark, p, tokens, shares, pull=mixing.PULL):
    cells = stage(spark.createDataFrame([(*map(float, x), int(t)) for x, t in zip(p, tokens)], "p_high double, p_low double, p_toxic double, tokens long"), "t")
    rates = mixing.fit_rates(cells, dict(zip(mixing.DOMAINS, shares)), 0.95, pull)
    rows = cells.select("p_high", "p_low", "p_toxic", "tokens", rates.fold([F.col(f"p_{d}") for d in mixing.DOMAINS])["r"].alias("r")).collect()
    p, w, r = (np.array(x, float) for x in ([list(x)[:3] for x in rows], [x["tokens"] for x in rows], [x["r"] for x in rows]))
    return (w / w.sum() * r) @ p, r, rows


def test_feasible_targets_are_met(spark):
    # A domain with 1 % of the tokens and a goal of 9.5 % needs rates of 9.5.
    totals, r, rows = reached(spark, np.eye(3), [9800, 100, 100], (0.8, 0.1, 0.1), 1e-6)
    assert np.abs(totals - 0.95 * np.array([0.8, 0.1, 0.1])).max() < 1e-5
    assert {round(x["r"], 2) for x in rows if x["tokens"] == 100} == {9.5}
    rng = np.random.default_rng(4)
    p = np.vstack([np.eye(3), rng.dirichlet([4, 0.5, 0.5], 300)])
    tokens = [3, 3, 3, *rng.integers(1, 500, 300)]
    for shares in ((0.82, 0.08, 0.1), (0.5, 0.2, 0.3), (0.6, 0.35, 0.05)):
        goal = 0.95 * np.array(shares)
        assert (np.abs(reached(spark, p, tokens, shares)[0] - goal) < 0.01 * goal).all()            # with the pull of the query
    # Of many ways to meet what is met already, the rates that stay at one.
    w = np.array(tokens) / sum(tokens)
    assert np.abs(reached(spark, p, tokens, w @ p)[1] - 0.95).max() < 0.06


def test_targets_beyond_the_posteriors_are_approached_as_near_as_can_be(spark):
    # Every posterior has a fifth or more of toxic: of the two rays, the nearest point of their cone in the measure of the fit.
    p, tokens = np.array([[0.8, 0.0, 0.2], [0.1, 0.7, 0.2], [0.1, 0.1, 0.8]]), np.array([500, 300, 200])
    goal, w = 0.95 * np.array([0.6, 0.35, 0.05]), tokens / 1000
    half = np.linalg.cholesky(np.linalg.inv((p * w[:, None]).T @ p)).T
    face = half @ p[:2].T
    nearest = p[:2].T @ np.linalg.lstsq(face, half @ goal, rcond=None)[0]
    totals, r, _ = reached(spark, p, tokens, (0.6, 0.35, 0.05), 1e-6)
    assert np.abs(totals - nearest).max() < 1e-3 and min(r) == 0


def test_registered_targets_keep_the_corpus(spark):
    """At 0.1: totals within 1 % of their targets, nine tenths of the documents stay, none takes more than a thousandth."""
    path = "/root/testdata/sf0.1"
    docs = table(spark, path, "documents")
    rows = stage(mixing.mix(docs, table(spark, path, "labels")), "t-mix")
    f = rows.agg(*[F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{d}")).alias(d) for d in mixing.DOMAINS], F.sum("n_tokens").alias("n"),
                 F.count_if(F.col("copies") > 0).alias("kept"), F.sum("copies").alias("copies"), F.max("copies").alias("most"), F.count("*").alias("docs")).first()
    for d, share in mixing.TARGETS.items():
        goal = mixing.BUDGET * share / sum(mixing.TARGETS.values())
        assert abs(f[d] / f["n"] - goal) < 0.01 * goal, d
    assert f["kept"] > 0.85 * f["docs"] and f["most"] <= 8 and f["most"] < f["copies"] / 1000


def test_cells_share_out_what_rounding_leaves(spark):
    model = mixing.Classifier([0.5, 0.3, 0.2], [[0] * 4, [0] * 4], (1.0, 1.0))
    rows = spark.range(1).select(F.lit(0).alias("s1"), F.lit(0).alias("s2")).withColumns(model.cell()).withColumns(mixing.posteriors()).first()
    assert (rows["p_high"], rows["p_low"], rows["p_toxic"]) == (0.5, 0.3, 0.2)
    rng = np.random.default_rng(1)
    s = rng.integers(-3000, 3000, (400, 2))
    got = spark.createDataFrame([(int(a), int(b)) for a, b in s], "s1 long, s2 long").withColumns(model.cell()).withColumns(mixing.posteriors()).collect()
    z = np.column_stack([np.full(400, np.log(0.5)), np.log(0.3) + s[:, 0] / mixing.UNIT, np.log(0.2) + s[:, 1] / mixing.UNIT])
    true = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    mine = np.array([[r["p_high"], r["p_low"], r["p_toxic"]] for r in got])
    assert np.abs(mine - true).max() < 1 / mixing.GRID and np.abs((mine - true).mean(axis=0)).max() < 0.2 / mixing.GRID


def test_copies_of_one_row_are_dealt_over_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "doc_id long, text string")
    member = docs.withColumns({k: F.lit(0) for k in mixing.CELL})
    rates = spark.createDataFrame([(0, 0, 200.0)], ", ".join(f"{k} int" for k in mixing.CELL) + ", rate double")
    monkeypatch.setattr(mixing, "_fitted", lambda *a: (None, rates, None))
    monkeypatch.setattr(mixing, "_scored", lambda d, m, t, *keep: member.select(*keep, *mixing.CELL))
    again = mixing.resample(docs, None)
    assert sorted(map(str, (tuple(r) for r in again.collect()))) == sorted(str(x) for x in [(1, "a"), (2, "b"), (3, "c"), (None, "d")] for _ in range(200))


def test_mix_follows_targets_and_labels(spark):
    rng = np.random.default_rng(5)
    say = lambda words, n: " ".join(rng.choice(words, n))
    good, bad = [f"w{i}" for i in range(200)], ["idiot", "scum"]
    docs = [(i, say(good, 80) + (" " + say(bad, 6) if i % 4 == 0 else ""), i % 4 == 0) for i in range(600)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in docs], "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(i, 1, int(x)) for i, _, x in docs if i % 3] + [(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(df, labels).collect()
    assert len(rows) == len(docs)
    by = {r["doc_id"]: r for r in rows}
    for i, _, toxic in docs:
        assert (by[i]["p_toxic"] > 0.5) == toxic and by[i]["copies"] in (int(by[i]["rate"]), int(by[i]["rate"]) + 1)
    assert np.mean([by[i]["rate"] for i, _, x in docs if x]) < 0.7 * np.mean([by[i]["rate"] for i, _, x in docs if not x])
    again = mixing.resample(df, labels)
    assert again.columns == df.columns
    count = {r["doc_id"]: r["count"] for r in again.groupBy("doc_id").count().collect()}
    assert count == {i: r["copies"] for i, r in by.items() if r["copies"]}


def test_mix_edge_cases(spark, nasty, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (9, 0, 1), (77, 1, None)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(nasty, labels).collect()
    assert len(rows) == nasty.count()
    assert all(abs(r["p_high"] + r["p_low"] + r["p_toxic"] - 1) < 1e-9 and 0 <= r["rate"] <= mixing.MAX_RATE for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    assert mixing.resample(nasty, labels).columns == nasty.columns
    assert mixing.mix(empty, labels).count() == 0 and mixing.resample(empty, labels.limit(0)).count() == 0
    assert mixing.mix(nasty, labels.limit(0)).count() == nasty.count()


def test_pipeline_stages(spark, sf):
    """Every stage against what its operator says of the rows it was given."""
    from tiffin.llm import langid, minhash, nbest, pii
    from test_dedup import brute_documents
    docs = table(spark, sf, "documents")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "personal_data", "mixing", "sentencepiece"]
    work = dict(corpus_pipeline.STAGES)

    junk = spark.createDataFrame([(10_000, "0 1 2 3 !!", None, "s", 10), (10_001, None, "en", "s", 0), (10_002, "漢字 仮名 交じり", None, "s", 9)], docs.schema)
    kept = stage(work["language_id"](spark, docs.unionAll(junk), sf), "t1")
    assert kept.columns == names and kept.where("doc_id >= 10000").count() == 0
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}

    unique = stage(work["minhash_near_dedup"](spark, kept, sf), "t2")
    _, label = brute_documents([(r["doc_id"], r["text"]) for r in kept.collect()], 80, 5)
    assert unique.columns == names and sorted(r["doc_id"] for r in unique.collect()) == sorted(set(label.values()))

    private = stage(work["personal_data"](spark, unique, sf), "t3")
    before = {r["doc_id"]: r["text"] for r in unique.collect()}
    assert private.columns == names
    for r in private.collect():
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not pii.candidates(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]

    mixed = stage(work["mixing"](spark, private, sf), "t4")
    said = {r["doc_id"]: r["copies"] for r in mixing.mix(private, table(spark, sf, "labels")).collect()}
    assert mixed.columns == names and {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: c for i, c in said.items() if c}

    pieces = work["sentencepiece"](spark, mixed, sf).collect()
    assert len(pieces) == mixed.count() and all(r["round_trip"] for r in pieces)


def test_near_dedup_keeps_one_row_of_repeated_ids_and_of_copies_without_id(spark, nasty):
    work = dict(corpus_pipeline.STAGES)["minhash_near_dedup"]
    text = "one two three four five six seven eight nine ten"
    row = nasty.first().asDict()
    rows = [dict(row, doc_id=i, text=t, source=s) for i, t, s in [
        (1, text, "b"), (1, text, "a"), (2, text, "a"), (3, "quite another text of some other words here", "a"), (3, "same id and not the same text at all, ever", "a"),
        (None, "no id", "x"), (None, "no id", "x"), (None, "no id", "y"), (None, "other, no id", "x"), (None, None, "x"), (None, None, "x"), (4, None, "x"), (4, None, "x")]]
    got = work(spark, spark.createDataFrame([tuple(r[c] for c in nasty.columns) for r in rows], nasty.schema), "")
    assert got.columns == nasty.columns
    kept = sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=str)
    assert [i for i, _ in kept if i is not None] == [1, 3, 4] and [t for i, t in kept if i is None] == ["", "no id", "other, no id"]
    assert [r["source"] for r in got.where("doc_id = 1").collect()] == ["a"]


def test_stages_take_odd_rows(spark, nasty, sf):
    """Nulls, repeated rows, clashing names and extra columns, through every stage."""
    for name, work in corpus_pipeline.STAGES[:-1]:
        out = work(spark, nasty, sf)
        assert out.columns == nasty.columns, name
        out.count()
    assert dict(corpus_pipeline.STAGES)["sentencepiece"](spark, nasty, sf).count() == nasty.count()


def test_pipeline_on_nothing(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, work in corpus_pipeline.STAGES:
        docs = stage(work(spark, docs, sf), "none")
    assert docs.count() == 0
    assert set(corpus_pipeline.QUERIES) == {"pipeline"} and corpus_pipeline.ORACLE_SQL is None


def test_stages_bound_the_batches_of_what_they_return(spark, sf):
    from tiffin.llm.common import BATCH
    key, size = BATCH
    docs = table(spark, sf, "documents").limit(30)
    work = {name: f for name, f in corpus_pipeline.STAGES if name in ("language_id", "personal_data", "sentencepiece")}
    try:
        for f in work.values():
            spark.conf.unset(key)
            f(spark, docs, sf)
            assert spark.conf.get(key) == size
            spark.conf.set(key, "7m")                    # a caller's own value stays
            f(spark, docs, sf)
            assert spark.conf.get(key) == "7m"
    finally:
        spark.conf.unset(key)
