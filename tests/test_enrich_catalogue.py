import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tiffin.operators import catalogue as K
from tiffin.operators import enrich as E

REVIEW_SCHEMA = ("review_id long, order_id long, user_id long, restaurant_id string, rating long, comment string, "
                 "review_date date")


def classify(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "comment string")
    return [(r.sentiment, r.category) for r in E.classify(df).collect()]


def test_keyword_traps(spark):
    out = classify(spark, ["delivery was not on time", "i was unhappy", "great food, served on a clean plate",
                           "the breakfast arrived cold", "staff were rude", "okay", "too expensive",
                           "nice eco-friendly package", "GREAT Service"])
    assert out == [("positive", "delivery"), ("neutral", "other"), ("neutral", "delivery"),
                   ("neutral", "delivery"), ("negative", "service"), ("neutral", "other"),
                   ("neutral", "price"), ("positive", "packaging"), ("positive", "service")]


def test_mart_shape_score_and_issue(spark):
    df = spark.createDataFrame([(1, "slow and cold, the worst"), (2, "lovely"), (3, "good but late")],
                               "review_id long, comment string")
    out = {r.review_id: r for r in E.review_enriched(df).collect()}
    assert out["1"].sentiment_score == -1.0 and out["1"].key_issue == "slow" and out["1"].topic == "Delivery"
    assert out["2"].sentiment_label == "positive" and out["2"].key_issue is None and out["2"].topic == "Other"
    assert out["3"].sentiment_score == 0.0 and out["3"].key_issue == "late"


def _reviews(spark):
    d = dt.date(2024, 1, 1)
    rows = [(i, i, 1, "7", 5, "good", d + dt.timedelta(days=i)) for i in range(1, 8)]
    rows.append((99, 99, 1, "7", 5, None, d))
    rows.append((50, 50, 1, "7", 5, "late again", None))
    return spark.createDataFrame(rows, REVIEW_SCHEMA)


def test_new_only_makes_progress_and_literal_order_stalls(spark):
    r = _reviews(spark)
    done = spark.createDataFrame([(i,) for i in range(1, 6)], "review_id long")
    batch = [x.review_id for x in E.reviews_to_enrich(r, done, batch_size=5).collect()]
    assert sorted(batch) == [6, 7, 50]                 # nulls last, comment required
    stalled = E.reviews_to_enrich(r, done, batch_size=5, oldest_first_then_skip=True).collect()
    assert stalled == []                               # the oldest five are all done already
    s = E.enrich_summary(r, done).first()
    assert (s.total, s.skipped, s.processed) == (8, 5, 3)


def test_confidence_range_and_determinism(spark):
    df = spark.range(0, 200).select(E.confidence("id").alias("c"))
    vals = [r.c for r in df.collect()]
    assert min(vals) == 0.8 and max(vals) == 0.98 and vals == [r.c for r in df.collect()]


def test_pluggable_model_routes_failures(spark):
    def flaky(texts: pd.Series) -> pd.DataFrame:
        if any("boom" in str(t) for t in texts):
            raise RuntimeError("remote error")
        return E.keyword_model(texts)

    r = spark.createDataFrame([(1, "good"), (2, "boom"), (3, "bad")], "review_id long, comment string")
    ok, bad = E.split_rejects(E.enrich_with_model(r.repartition(1), flaky))
    assert sorted((x.review_id, x.sentiment) for x in ok.collect()) == [(1, "positive"), (3, "negative")]
    rejects = bad.collect()
    assert [x.review_id for x in rejects] == [2] and "remote error" in rejects[0].error


def test_parse_model_json(spark):
    df = spark.createDataFrame([('{"sentiment":"positive","category":"price","confidence":0.9}',),
                                ("not json",), ('{"sentiment":"negative"}',)], "s string")
    out = [r.p for r in df.select(E.parse_model_json("s").alias("p")).collect()]
    assert out[0].category == "price" and out[1].sentiment is None and out[2].category is None


EXAMPLES = ["Top 10 cities by GMV", "Which cuisine has the most orders?", "Average delivery time by city, worst first",
            "Cancel rate by payment method", "Top 10 restaurants by revenue", "What is the average order value?",
            "Which city has the highest cancellation rate?", "Show the number of orders by payment method",
            "What is the average delivery time?", "Top 10 cuisines by revenue", "  ORDERS ", "how many orders today",
            "Tell me a joke"]


def test_routing_examples(spark):
    df = spark.createDataFrame([(q,) for q in EXAMPLES], "q string")
    out = [tuple(r) for r in df.select(K.route("q"), K.route("q", plural_aware=True)).collect()]
    assert [a for a, _ in out] == [None, "cuisine_orders", "delivery_by_city", "cancel_by_payment",
                                   "restaurant_revenue", "aov", "cancel_city", "orders_by_payment", "avg_delivery",
                                   "cuisine_revenue", "total_orders", "total_orders", None]
    assert out[0][1] == "city_gmv"


SQLS = [("", False), ("-- hi\nselect 1", False), ("select 1; drop table x", False), ("select created_at from t", True),
        ("select replace(a,'x','y') from t", False), ("/* drop */ select 1", False), ("select 1 -- delete", True),
        ("with t as (select 1) select * from t", True), ("  SELECT 1  ", True), (None, False),
        ("select a from t where b = 'x;y'", False), ("select dropped from t", True)]


def test_safety_filter(spark):
    df = spark.createDataFrame([(s,) for s, _ in SQLS], "s string")
    got = [r[0] for r in df.select(K.is_safe("s")).collect()]
    assert got == [ok for _, ok in SQLS]
    v1 = [r[0] for r in df.select(K.is_safe_v1("s")).collect()]
    assert v1[3] is False and v1[11] is False      # plain substring: created_at / dropped rejected
    assert v1[2] is False and v1[7] is True


def test_normalize_sql_text(spark):
    df = spark.createDataFrame([("  select * from TIFFIN.MARTS.fct_orders;; ",), ("select 1",)], "s string")
    assert [r[0] for r in df.select(K.normalize_sql_text("s")).collect()] == ["select * from fct_orders", "select 1"]


def test_run_sql_refuses_unsafe(spark):
    with pytest.raises(K.UnsafeQueryError):
        K.run_sql(spark, "drop table x")
    assert K.run_sql(spark, "select 1 as x").first().x == 1


def test_whole_words_mode(spark):
    df = spark.createDataFrame([("great food, served on a clean plate",), ("late again",), ("not on time",)],
                               "comment string")
    out = [(r.sentiment, r.category, r.key_issue) for r in E.classify(df, whole_words=True).collect()]
    assert out == [("positive", "food_quality", None), ("negative", "delivery", "late"),
                   ("positive", "delivery", None)]


def test_parse_answers_rejects_prose_and_missing_fields(spark):
    df = spark.createDataFrame([
        (1, '{"sentiment":"positive","category":"delivery","confidence":0.9}'),
        (2, "Sorry, I cannot classify this review."),
        (3, '{"sentiment":"negative","category":"price"}'),
        (4, None),
        (5, '{"sentiment":"neutral","category":"other","confidence":"high"}'),
    ], "review_id long, answer string")
    out = {r.review_id: r for r in E.parse_answers(df).collect()}
    assert (out[1].sentiment, out[1].category, out[1].confidence, out[1].rejected) == \
        ("positive", "delivery", 0.9, False)
    assert all(out[k].rejected for k in (2, 3, 4, 5))
    assert out[3].sentiment == "negative" and out[3].confidence is None


def test_model_answers_round_trip(spark):
    df = spark.createDataFrame([(1, "great and fast"), (2, "okay")], "review_id long, comment string")
    out = {r.review_id: r for r in E.parse_answers(E.model_answers(df)).collect()}
    assert out[1].sentiment == "positive" and out[1].category == "delivery" and not out[1].rejected
    assert 0.80 <= out[1].confidence <= 0.98
    assert out[2].rejected and out[2].sentiment is None


def test_append_is_idempotent(spark, tmp_dir):
    from tiffin.plans.pipeline import append_new_enrichment
    reviews = _reviews(spark)   # 8 reviews with a comment
    path = f"{tmp_dir}/enriched"
    first = append_new_enrichment(spark, reviews.where(F.col("review_id") <= 3), path).count()
    second = append_new_enrichment(spark, reviews, path).count()
    third = append_new_enrichment(spark, reviews, path)
    assert (first, second) == (3, 8)
    assert third.count() == 8 and third.select("review_id").distinct().count() == 8


def test_keyed_texts_reach_every_outcome(spark):
    from tiffin.operators import catalogue as C
    from tiffin.sources.fixtures import QUESTION_TEXTS, SQL_TEXTS
    q = spark.createDataFrame([(t,) for t in QUESTION_TEXTS], "t string").select(C.route("t").alias("a"), C.route("t", True).alias("b")).collect()
    every = {tid for tid, _ in C.ROUTES} | {None}
    assert {r.a for r in q} == every == {r.b for r in q} and any(r.a != r.b for r in q)
    s = spark.createDataFrame([(t,) for t in SQL_TEXTS], "t string").select(
        "t", C.is_safe("t").alias("a"), C.is_safe_v1("t").alias("b"), C.normalize_sql_text("t").alias("n")).collect()
    assert {(r.a, r.b) for r in s} == {(True, True), (True, False), (False, True), (False, False)}
    assert sum(r.n != r.t for r in s) >= 6


def test_a_batch_that_broke_off_or_ran_twice_leaves_one_copy(spark, tmp_dir):
    import datetime as dt
    from pyspark.sql import functions as F
    from tiffin.operators import enrich as E
    from tiffin.plans.pipeline import append_new_enrichment
    path = f"{tmp_dir}/enriched"
    day = dt.date(2024, 1, 1)
    reviews = spark.createDataFrame([(i, i, i, str(i), 5, f"great food {i}" if i % 5 else "broken", day) for i in range(1, 41)],
                                    "review_id long, order_id long, user_id long, restaurant_id string, rating long, comment string, review_date date")

    def dies_in_the_second_half(rows):
        return rows.repartition(4, "review_id").withColumn("rating", F.when(F.col("review_id") > 20, F.raise_error(F.lit("lost"))).otherwise(F.col("rating")))

    def picky(texts):
        if (texts == "broken").any():
            raise ValueError("no")
        return E.keyword_model(texts)

    append_new_enrichment(spark, reviews.where("review_id <= 10"), path, batch_id="d1")
    with pytest.raises(Exception):
        append_new_enrichment(spark, dies_in_the_second_half(reviews), path, batch_id="d2")
    assert spark.read.parquet(path).count() == 10                       # nothing of the broken batch is seen
    append_new_enrichment(spark, reviews, path, batch_id="d2")
    got = append_new_enrichment(spark, reviews, path, batch_id="d2")    # the same batch twice
    assert sorted(r.review_id for r in got.collect()) == list(range(1, 41))
    assert got.where("batch = 'run-d1'").count() == 10
    model = f"{tmp_dir}/model"
    for _ in range(2):
        append_new_enrichment(spark, reviews, model, model=picky, batch_id="d1")
    assert spark.read.parquet(model).count() == 32 and spark.read.parquet(f"{model}_rejects").count() == 8


def test_answers_of_any_shape(spark):
    rows = [(1, '{"sentiment":"positive","category":"delivery","confidence":0.9,"note":{"a":1}}'),
            (2, '{"sentiment_label":"negative","sentiment_score":-0.5,"topic":"Delivery","key_issue":"late"}'),
            (3, '{"sentiment_label":"neutral","sentiment_score":0,"topic":"Other"}'), (4, '{"sentiment":"positive","confidence":0.9}'),
            (5, '{"sentiment":"positive","category":"delivery","confidence":"high"}'), (6, "Sorry, no."), (7, None), (8, ""), (9, "[1, 2]"), (10, '{"sentiment":')]
    got = {r.review_id: r for r in E.parse_any_answer(spark.createDataFrame(rows, "review_id long, answer string")).collect()}
    assert (got[1]["shape"], got[1].sentiment, got[1].topic, got[1].score, got[1].key_issue) == ("active", "positive", E.TOPIC_BY_CATEGORY["delivery"], 0.9, None)
    assert (got[2]["shape"], got[2].sentiment, got[2].topic, got[2].score, got[2].key_issue) == ("mart", "negative", "Delivery", -0.5, "late")
    assert got[3]["shape"] == "mart" and got[3].score == 0.0 and got[3].key_issue is None
    assert all(got[i].rejected and got[i]["shape"] is None and got[i].sentiment is None for i in range(4, 11))
    assert not any(got[i].rejected for i in (1, 2, 3))
