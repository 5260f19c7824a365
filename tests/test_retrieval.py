import numpy as np
from pyspark.sql import functions as F

from tiffin.operators import retrieval as R


def brute_topk(ids, vecs, queries, k, digits=None):
    out = {}
    for qid, q in queries:
        q = np.asarray(q, float)
        rows = []
        for i, v in zip(ids, vecs):
            v = np.asarray(v, float)
            den = np.linalg.norm(q) * np.linalg.norm(v)
            s = 0.0 if den == 0 else float(np.dot(q, v) / den)
            if digits is not None:
                s = float(R.round_half_away(np.array([s]), digits)[0])
            rows.append((-s, i))
        out[qid] = [i for _, i in sorted(rows)[:k]]
    return out


def test_cosine_topk_matches_brute_force_with_a_hot_duplicate_group(spark):
    rng = np.random.default_rng(3)
    n, d = 3000, 16
    vecs = rng.normal(size=(n, d))
    vecs[: n // 3] = vecs[0]                 # a third of all rows are one vector (ties)
    vecs[5] = 0.0                            # a zero vector scores 0
    ids = list(range(n))
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, vecs)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(7)
    queries = [(1, list(vecs[0])), (2, list(rng.normal(size=d))), (3, [0.0] * d)]
    got = R.cosine_topk(df, "id", "v", queries, k=5, digits=6).collect()
    by_q = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by_q.setdefault(r.query_id, []).append(r.id)
    assert by_q == brute_topk(ids, vecs, queries, 5, digits=6)
    assert by_q[1] == [0, 1, 2, 3, 4] and by_q[3] == [0, 1, 2, 3, 4]


def test_keyword_vector_and_retrieve(spark):
    corpus = spark.createDataFrame(
        [(1, "Pune", 5, "fast delivery"), (2, None, 2, "late delivery, cold food"), (3, "Goa", 4, "nothing here"),
         (4, "Goa", 3, "great staff")], "review_id long, city string, rating long, comment string")
    vecs = R.review_vectors(corpus)
    v1 = vecs.where("review_id = 1").first().embedding
    assert len(v1) == 33 and v1[R.EMBED_KEYWORDS.index("delivery")] == 1.0 and sum(v1) == 2.0
    qs = spark.createDataFrame([(1, "How is the delivery?"), (2, "What is the rating?"), (3, "staff service")],
                               "question_id int, question string")
    top = R.retrieve(vecs, qs, k=2)
    got = {(r.query_id, r.rank): r.review_id for r in top.collect()}
    assert got[(1, 1)] == 1 and got[(1, 2)] == 2       # 1/sqrt(2) beats 1/sqrt(3)
    assert got[(2, 1)] == 1 and got[(2, 2)] == 2       # zero question vector: ties by id
    ans = {r.question_id: r.answer for r in R.answer_questions(top, qs).collect()}
    assert ans[1].startswith("Based on the 2 most relevant reviews")
    assert ans[2] == "The average rating among the 2 most relevant reviews is 3.5 stars."
    assert ans[3] == R.TEXT_SERVICE
    ctx = {r.question_id: r.prompt for r in R.build_context(top, qs).collect()}
    assert ctx[1] == ("Question: How is the delivery?\n\nReviews:\n(Pune, 5 stars) fast delivery\n"
                      "(None, 2 stars) late delivery, cold food\n")


def test_score_against_all_pairs(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0, 5.0]), (4, None), (5, [None, 1.0])], "id long, v array<double>")
    qdf = spark.createDataFrame([(7, [1.0, 1.0]), (8, None)], "q long, qv array<double>")
    out = {(r.query_id, r.id): r.score for r in R.score_against_all(corpus, "id", "v", qdf, "q", "qv").collect()}
    assert set(out) == {(7, 1), (7, 2)}        # unequal lengths, null vectors and null parts have no score
    assert abs(out[(7, 1)] - 2 ** -0.5) < 1e-15 and out[(7, 2)] == 0.0


def test_sample_rows_is_stable(spark):
    from tiffin.operators.sampling import sample_rows
    df = spark.range(0, 1000).repartition(5)
    a = sorted(r.id for r in sample_rows(df, 50, "id").collect())
    b = sorted(r.id for r in sample_rows(df.repartition(3), 50, "id").collect())
    assert a == b and len(a) == 50


def test_vector_cache_embeds_new_reviews_only(spark, tmp_dir):
    from pathlib import Path
    rows = [(i, "Pune", 5, f"good food {i}") for i in range(6)]
    reviews = spark.createDataFrame(rows, "review_id long, city string, rating long, comment string")
    seen = []

    def embed(df):
        seen.append(sorted(r.review_id for r in df.select("review_id").collect()))
        return R.review_vectors(df)

    path = f"{tmp_dir}/vec"
    assert R.cached_vectors(spark, path, reviews.where("review_id < 4"), embed, "m1").count() == 4
    assert R.cached_vectors(spark, path, reviews, embed, "m1").count() == 6
    assert R.cached_vectors(spark, path, reviews, embed, "m1").count() == 6
    (Path(path) / "version=m1" / "part-broken").mkdir()           # a refresh that never finished
    (Path(path) / "version=m1" / "part-broken" / "part-0.parquet").write_bytes(b"not parquet")
    assert R.cached_vectors(spark, path, reviews, embed, "m1").count() == 6
    assert R.cached_vectors(spark, path, reviews, embed, "m2").count() == 6
    assert seen == [[0, 1, 2, 3], [4, 5], [], [], [0, 1, 2, 3, 4, 5]]


def test_more_queries_than_one_pass_holds(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    monkeypatch.setattr(R, "ROW_BLOCK", 90)
    rng = np.random.default_rng(5)
    n, d = 400, 8
    vecs = rng.normal(size=(n, d))
    ids = list(range(n))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vecs)], "id long, v array<double>")
    queries = [(q, [float(x) for x in rng.normal(size=d)]) for q in range(1, 12)]   # 11 queries, batches of <= 4
    qdf = spark.createDataFrame(queries, "qid int, qv array<double>")
    got = R.cosine_topk_all(df, "id", "v", qdf, "qid", "qv", k=3, digits=6).collect()
    by_q = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by_q.setdefault(r.query_id, []).append(r.id)
    assert by_q == brute_topk(ids, vecs, queries, 3, digits=6)


def test_query_ids_of_any_kind_and_odd_vectors(spark, monkeypatch):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 0.0], None), (3, [1.0, 1.0], "c"), (4, None, "d"), (5, [1.0], "e"), (6, [float("nan"), 1.0], "f")],
                               "id long, v array<double>, note string")
    for kind, ids in (("string", ["x", "y", None]), ("long", [1 << 40, 2, None]), ("int", [1, 2, None])):
        for block in (1024, 1):
            monkeypatch.setattr(R, "QUERY_BLOCK", block)
            qdf = spark.createDataFrame([(ids[0], [1.0, 0.0]), (ids[0], [1.0, 0.0]), (ids[1], [2.0]), (ids[2], [0.0, 3.0]), (ids[1], None)], f"q {kind}, qv array<double>")
            top = R.cosine_topk_all(df, "id", "v", qdf, "q", "qv", k=2, keep=["note"])
            assert dict(top.dtypes)["query_id"] == {"long": "bigint"}.get(kind, kind)
            got = {(r.query_id, r["rank"]): (r.id, r.note) for r in top.collect()}
            assert got == {(ids[0], 1): (1, "a"), (ids[0], 2): (3, "c"), (ids[1], 1): (5, "e"), (None, 1): (3, "c"), (None, 2): (1, "a")}
    assert R.cosine_topk_all(df, "id", "v", qdf.limit(0), "q", "qv").count() == 0


def test_samples_beyond_the_group_limit(spark):
    from tiffin.operators.sampling import first_n, sample_rows
    df = spark.range(20_000).repartition(7)
    got = first_n(df, 5000, [-F.col("id")])
    assert sorted(r.id for r in got.collect()) == list(range(15_000, 20_000))
    assert sample_rows(df, 5000, "id").count() == 5000 and first_n(df, 30_000, [F.col("id")]).count() == 20_000
    assert {r.id for r in sample_rows(df, 900, "id").collect()} < {r.id for r in sample_rows(df, 5000, "id").collect()}


def test_first_n_equals_a_sort_for_any_n_and_partitioning(spark):
    import datetime as dt
    import decimal
    import random
    from tiffin.operators.sampling import first_n
    rng = random.Random(3)
    day = dt.date(1969, 12, 1)
    rows = [(i, rng.choice([None, rng.randint(-(1 << 63) + 5, (1 << 63) - 1), rng.randint(-4, 4)]),
             rng.choice([None, "", "a", "a\0", "ab", "abcdefgh", "abcdefghi", "Zürich", "x" * 40 + str(i)]),
             rng.choice([None, day + dt.timedelta(days=rng.randint(0, 60))]),
             rng.choice([None, dt.datetime(1960 + rng.randint(0, 70), 1, 1, 3, 4, 5, rng.randint(0, 9))]),
             rng.choice([None, decimal.Decimal(rng.randint(-500, 500)) / 100]), rng.choice([None, True, False])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, n long, s string, d date, t timestamp_ntz, m decimal(9,2), b boolean")
    high = lambda r, c: (r[c] is None, r[c].encode() if isinstance(r[c], str) else r[c] or 0 if c != 3 and c != 4 else r[c] or (day if c == 3 else dt.datetime(1, 1, 1)))
    at = {"id": 0, "n": 1, "s": 2, "d": 3, "t": 4, "m": 5, "b": 6}
    for order in (["n", "id"], ["s", "n", "id"], ["d", "id"], ["t", "s", "id"], ["b", "m", "id"]):
        want = [r[0] for r in sorted(rows, key=lambda r: [high(r, at[c]) for c in order])]
        for n, parts in ((1, 5), (700, 2), (1499, 3)):
            got = first_n(df.repartition(parts), n, [F.col(c) for c in order])
            assert got.columns == df.columns and sorted(r.id for r in got.collect()) == sorted(want[:n]), (order, n)
    # rows equal in the order: exactly n, all that are surely in
    same = spark.range(100).select("id", (F.col("id") >= 10).cast("int").alias("g"))
    got = [r.id for r in first_n(same, 30, [F.col("g")]).collect()]
    assert len(got) == 30 and set(range(10)) <= set(got)
    assert first_n(same, 0, [F.col("g")]).count() == 0 and first_n(same.limit(0), 5, [F.col("g")]).count() == 0


def test_first_n_is_one_filter(spark):
    from tiffin.operators.sampling import sample_rows
    plan = sample_rows(spark.range(50_000), 700, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "Exchange" not in plan


def test_label_centroids_ragged_vectors(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [3.0, 4.0, 6.0]), (3, 1, [5.0, 5.0])],
                               "vec_id long, label int, embedding array<double>").coalesce(1)
    got = {r.label: list(r.v) for r in R.label_centroids(df).collect()}
    assert got == {0: [2.0, 3.0, 6.0], 1: [5.0, 5.0, None]}


def test_class_scoring_equals_scoring_every_row(spark):
    import random
    rng = random.Random(8)
    kinds = [[1.0, 0.0, 1.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [2.0, 0.0, 2.0], [0.0, 1.0], [1.0, None, 0.0], None, []]
    rows = [(i, kinds[0] if i % 3 == 0 else rng.choice(kinds), "t") for i in rng.sample(range(5000), 900)]    # a third share one vector
    df = spark.createDataFrame(rows, "id long, v array<double>, note string").repartition(6)
    qs = spark.createDataFrame([(1, [1.0, 0.0, 1.0]), (2, [0.0, 1.0, 0.0]), (None, [1.0, 1.0]), (4, [0.0, 0.0, 0.0]), (5, [3.0])], "q int, qv array<double>")
    for k in (1, 5, 400, 2000):
        a = R.class_topk(df, "id", "v", qs, "q", "qv", k, keep=["note"])
        b = R.cosine_topk_all(df, "id", "v", qs, "q", "qv", k, keep=["note"])
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect())), k
    assert R.vector_classes(df, "id", "v", 5).count() == len(kinds) - 1
    every = R.score_against_all(df, "id", "v", qs, "q", "qv").collect()
    want = {}
    for r in every:
        key = (-r.score, r.query_id is not None, r.query_id or 0)                # a null id is the smallest
        if r.id not in want or key < want[r.id][0]:
            want[r.id] = (key, r.query_id, r.score)
    got = {r.id: (r.query_id, r.score) for r in R.best_query_each(df, "id", "v", qs, "q", "qv").collect()}
    assert got == {i: w[1:] for i, w in want.items()}
    assert R.class_topk(df.limit(0), "id", "v", qs, "q", "qv").count() == 0
