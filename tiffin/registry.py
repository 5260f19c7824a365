"""Registered queries: key -> Spark DataFrame function and its SQL oracle.

Every query reads the driver's tables (through the RAW adapter) in full. Decimal
outputs are exposed as DOUBLE so both engines compare equal by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sources.fixtures import QUESTION_TEXTS, SQL_TEXTS
from .oracle import sql as O
from .plans.models import Models
from .sources.raw import RAW_SCHEMAS

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Decimal columns as DOUBLE; everything else unchanged."""
    return df.select([F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
                      else F.col(f.name) for f in df.schema.fields])


def register(key: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


_MODELS: dict[tuple[str, str], Models] = {}


def _models(spark: SparkSession, sf_dir: str) -> Models:
    """One lazily built model graph per session and data folder (plans are reused, never data)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _MODELS:
        _MODELS[key] = Models.from_driver(spark, sf_dir)
    return _MODELS[key]


def _model_query(name: str, decimals: list[str]) -> None:
    sel = O.as_double(decimals) if decimals else "*"

    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(_models(spark, sf_dir).table(name))
    register(name, O.with_ctes(f"SELECT {sel} FROM {name}"))(fn)


# ------------------------------------------------------------- staging / marts
for _name, _dec in [
    ("stg_restaurants", ["rating"]),
    ("stg_users", []),
    ("stg_food", []),
    ("stg_menu", ["price"]),
    ("stg_orders", ["subtotal", "discount", "delivery_fee", "gst", "sales_amount"]),
    ("stg_order_items", ["price", "line_amount"]),
    ("stg_reviews", []),
    ("dim_customers", []),
    ("dim_restaurants", ["rating"]),
    ("dim_food", []),
    ("fct_orders", ["subtotal", "discount", "delivery_fee", "gst", "sales_amount"]),
    ("fct_order_items", ["price", "line_amount"]),
    ("mart_daily_city_revenue", ["gmv"]),
    ("mart_delivery_sla", []),
    ("mart_delivery_value", []),
    ("mart_restaurant_performance", ["revenue"]),
    ("mart_review_insights", []),
]:
    _model_query(_name, _dec)


# ------------------------------------------------------------- named sources
@register("scan_sources", O.with_ctes("\nUNION ALL\n".join(
    [f"SELECT {O.q(n)} AS source, count(*) AS n_rows, {len(s.fields)} AS n_columns FROM raw_{n}"
     for n, s in RAW_SCHEMAS.items()]
    + ["SELECT 'review_enriched' AS source, count(*) AS n_rows, 7 AS n_columns FROM review_enriched"])))
def _scan_sources(spark, sf_dir):
    """The RAW tables are landed once, then scanned by name with their declared schemas."""
    from functools import reduce
    from .session import scratch_path
    from .sources.raw import scan_raw, write_raw
    m = _models(spark, sf_dir)
    root = scratch_path(spark, "raw")
    write_raw(m.raw, root)
    raw = scan_raw(spark, root)
    named = [(n, raw.get(n)) for n in raw.names()] + [("review_enriched", m.review_enriched)]
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(n).alias("source"), "n_rows", F.lit(len(df.columns)).alias("n_columns")) for n, df in named]
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------- calendar
@register("dim_date_covering", O.with_ctes(O.CALENDAR_SQL))
def _dim_date_covering(spark, sf_dir):
    from .plans.marts import dim_date_covering
    return dim_date_covering(_models(spark, sf_dir).fct_orders)


CALENDAR_END = "1997-12-31"


@register("dim_date_until", O.with_ctes(O.CALENDAR_SQL + f" WHERE d <= DATE '{CALENDAR_END}'"))
def _dim_date_until(spark, sf_dir):
    """The calendar of the orders, cut at a last day."""
    from .plans.marts import dim_date_covering
    return dim_date_covering(_models(spark, sf_dir).fct_orders, end=CALENDAR_END)


# ------------------------------------------------------------- scalar functions
@register("fn_city_cleanup", O.with_ctes(
    f"SELECT order_id, restaurant_city, {O.after_last_comma('restaurant_city')} AS city FROM raw_orders"))
def _fn_city(spark, sf_dir):
    from .functions.columns import after_last_comma
    return _models(spark, sf_dir).raw.orders.select("order_id", "restaurant_city",
                                                    after_last_comma("restaurant_city").alias("city"))


@register("fn_first_number", O.with_ctes(
    f"SELECT id, rating_count, cost, {O.first_number('rating_count')} AS rating_count_n, "
    f"{O.first_number('cost')} AS cost_n FROM raw_restaurants"))
def _fn_first_number(spark, sf_dir):
    from .functions.columns import first_number
    return _models(spark, sf_dir).raw.restaurants.select(
        "id", "rating_count", "cost", first_number("rating_count").alias("rating_count_n"),
        first_number("cost").alias("cost_n"))


@register("fn_try_number", O.with_ctes(
    f"SELECT user_id, age, family_size, {O.try_number('user_id')} AS user_id_n, {O.try_number('age')} AS age_n, "
    f"{O.try_number('family_size')} AS family_size_n FROM raw_users"))
def _fn_try_number(spark, sf_dir):
    from .functions.columns import try_number
    return _models(spark, sf_dir).raw.users.select(
        "user_id", "age", "family_size", try_number("user_id").alias("user_id_n"), try_number("age").alias("age_n"),
        try_number("family_size").alias("family_size_n"))


@register("fn_try_decimal", O.with_ctes(
    "SELECT menu_id, price, CAST(TRY_CAST(price AS DECIMAL(10,2)) AS DOUBLE) AS price_d FROM raw_menu"))
def _fn_try_decimal(spark, sf_dir):
    from .functions.columns import try_decimal
    return comparable(_models(spark, sf_dir).raw.menu.select("menu_id", "price",
                                                             try_decimal("price", 10, 2).alias("price_d")))


@register("fn_nullif", O.with_ctes(
    "SELECT id, rating, nullif(rating, '--') AS rating_text, "
    "CAST(TRY_CAST(nullif(rating, '--') AS DECIMAL(3,1)) AS DOUBLE) AS rating_d FROM raw_restaurants"))
def _fn_nullif(spark, sf_dir):
    from .functions.columns import null_if, try_decimal
    return comparable(_models(spark, sf_dir).raw.restaurants.select(
        "id", "rating", null_if("rating", "--").alias("rating_text"),
        try_decimal(null_if("rating", "--"), 3, 1).alias("rating_d")))


@register("fn_initcap", O.with_ctes(
    f"SELECT f_id, veg_or_non_veg, {O.initcap('veg_or_non_veg')} AS label, {O.initcap('item')} AS item_title "
    "FROM raw_food"))
def _fn_initcap(spark, sf_dir):
    from .functions.columns import initcap
    return _models(spark, sf_dir).raw.food.select("f_id", "veg_or_non_veg", initcap("veg_or_non_veg").alias("label"),
                                                  initcap("item").alias("item_title"))


@register("fn_div0", O.with_ctes(
    "SELECT city, count(CASE WHEN order_status = 'Cancelled' THEN 1 END) AS cancelled, "
    "count(CASE WHEN is_delivered THEN 1 END) AS delivered, "
    + O.sround("CASE WHEN count(CASE WHEN is_delivered THEN 1 END) = 0 THEN 0 ELSE "
               "count(CASE WHEN order_status = 'Cancelled' THEN 1 END) / count(CASE WHEN is_delivered THEN 1 END) END",
               4)
    + " AS cancel_per_delivered FROM fct_orders GROUP BY city"))
def _fn_div0(spark, sf_dir):
    from .functions.columns import div0
    c = F.count_if(F.col("order_status") == "Cancelled")
    d = F.count_if(F.col("is_delivered"))
    return _models(spark, sf_dir).fct_orders.groupBy("city").agg(
        c.alias("cancelled"), d.alias("delivered"), F.round(div0(c, d), 4).alias("cancel_per_delivered"))


@register("fn_round", O.with_ctes(
    "SELECT order_id, CAST(round(sales_amount, 0) AS DOUBLE) AS sales_amount_0, "
    "CAST(round(gst, 1) AS DOUBLE) AS gst_1, "
    + O.sround("CAST(delivery_time_min AS DOUBLE) / 7", 2) + " AS delivery_weeks_2, "
    + O.sround("CAST(sales_qty AS DOUBLE) / nullif(items_count, 0)", 3) + " AS qty_per_item_3 FROM fct_orders"))
def _fn_round(spark, sf_dir):
    """round on decimals (half-up, exact) and on doubles, over every order."""
    return comparable(_models(spark, sf_dir).fct_orders.select(
        "order_id", F.round("sales_amount", 0).alias("sales_amount_0"), F.round("gst", 1).alias("gst_1"),
        F.round(F.col("delivery_time_min").cast("double") / 7, 2).alias("delivery_weeks_2"),
        F.round(F.col("sales_qty") / F.nullif(F.col("items_count"), F.lit(0)), 3).alias("qty_per_item_3")))


@register("agg_count_if", O.with_ctes(
    "SELECT city, count(*) AS orders, count(CASE WHEN is_delivered THEN 1 END) AS delivered_orders, "
    "count(CASE WHEN order_status = 'Cancelled' THEN 1 END) AS cancelled_orders, "
    "count(CASE WHEN delivery_time_min IS NOT NULL THEN 1 END) AS timed_orders FROM fct_orders GROUP BY city"))
def _agg_count_if(spark, sf_dir):
    """count_if over a boolean, an equality and a not-null test, one aggregation pass."""
    return _models(spark, sf_dir).fct_orders.groupBy("city").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(F.col("is_delivered")).alias("delivered_orders"),
        F.count_if(F.col("order_status") == "Cancelled").alias("cancelled_orders"),
        F.count_if(F.col("delivery_time_min").isNotNull()).alias("timed_orders"))


@register("agg_conditional_sum", O.with_ctes(
    "SELECT restaurant_id, CAST(sum(CASE WHEN is_delivered THEN sales_amount ELSE 0 END) AS DOUBLE) "
    "AS delivered_revenue, CAST(sum(CASE WHEN order_status = 'Cancelled' THEN sales_amount ELSE 0 END) AS DOUBLE) "
    "AS cancelled_value, CAST(sum(CASE WHEN is_delivered THEN items_count ELSE 0 END) AS BIGINT) AS delivered_items "
    "FROM fct_orders GROUP BY restaurant_id"))
def _agg_conditional_sum(spark, sf_dir):
    """sum(iff(cond, x, 0)); a NULL condition takes the else branch."""
    from .functions.columns import iff
    f = _models(spark, sf_dir).fct_orders
    return comparable(f.groupBy("restaurant_id").agg(
        F.sum(iff(F.col("is_delivered"), F.col("sales_amount"), 0)).alias("delivered_revenue"),
        F.sum(iff(F.col("order_status") == "Cancelled", F.col("sales_amount"), 0)).alias("cancelled_value"),
        F.sum(iff(F.col("is_delivered"), F.col("items_count"), 0)).alias("delivered_items")))


@register("filter_castable", O.with_ctes(
    f"SELECT * FROM raw_users WHERE {O.try_number('user_id')} IS NOT NULL"))
def _filter_castable(spark, sf_dir):
    from .functions.columns import try_number
    raw = _models(spark, sf_dir).raw.users
    return raw.where(try_number("user_id").isNotNull())


# ------------------------------------------------------------- data quality
@register("dq_report", O.with_ctes(O.DQ_REPORT_SQL))
def _dq_report(spark, sf_dir):
    from .operators.quality import dq_report
    return dq_report(_models(spark, sf_dir))


@register("dq_unique", O.with_ctes(
    "SELECT order_id, count(*) AS n_records FROM fct_orders WHERE order_id IS NOT NULL GROUP BY order_id "
    "HAVING count(*) > 1"))
def _dq_unique(spark, sf_dir):
    from .operators.quality import unique_failures
    return unique_failures(_models(spark, sf_dir).fct_orders, "order_id")


@register("dq_unique_orders_of_items", O.with_ctes(
    "SELECT order_id, count(*) AS n_records FROM fct_order_items WHERE order_id IS NOT NULL GROUP BY order_id "
    "HAVING count(*) > 1"))
def _dq_unique_orders_of_items(spark, sf_dir):
    """Q1 on a column that does repeat: the orders with several items."""
    from .operators.quality import unique_failures
    return unique_failures(_models(spark, sf_dir).fct_order_items, "order_id")


@register("dq_not_null", O.with_ctes(
    "SELECT order_id, customer_id, restaurant_id FROM stg_orders WHERE restaurant_id IS NULL"))
def _dq_not_null(spark, sf_dir):
    from .operators.quality import not_null_failures
    return not_null_failures(_models(spark, sf_dir).stg_orders, "restaurant_id").select(
        "order_id", "customer_id", "restaurant_id")


@register("dq_relationships", O.with_ctes(
    "SELECT f.customer_id FROM fct_orders f WHERE f.customer_id IS NOT NULL AND NOT EXISTS "
    "(SELECT 1 FROM dim_customers d WHERE d.customer_id = f.customer_id)"))
def _dq_relationships(spark, sf_dir):
    from .operators.quality import relationship_failures
    m = _models(spark, sf_dir)
    return relationship_failures(m.fct_orders, "customer_id", m.dim_customers, "customer_id")


@register("dq_accepted_values", O.with_ctes(
    "SELECT order_status, count(*) AS n_records FROM fct_orders WHERE order_status IS NOT NULL AND "
    "order_status NOT IN ('Delivered', 'Cancelled', 'Refunded') GROUP BY order_status"))
def _dq_accepted(spark, sf_dir):
    from .operators.quality import accepted_values_failures
    return accepted_values_failures(_models(spark, sf_dir).fct_orders, "order_status",
                                    ["Delivered", "Cancelled", "Refunded"])


# ------------------------------------------------------------- enrichment
def _reviews_with_comment(spark, sf_dir) -> DataFrame:
    return _models(spark, sf_dir).raw.reviews.where(F.col("comment").isNotNull())


_RC = "FROM raw_reviews WHERE comment IS NOT NULL"


@register("keyword_sentiment", O.with_ctes(
    f"SELECT review_id, comment, CAST({O.count_contained('lower(comment)', O.enrich.POSITIVE_WORDS)} AS INTEGER) "
    f"AS positive_hits, CAST({O.count_contained('lower(comment)', O.enrich.NEGATIVE_WORDS)} AS INTEGER) "
    f"AS negative_hits, {O.sentiment('comment')} AS sentiment, {O.sentiment_score('comment')} AS sentiment_score "
    + _RC))
def _keyword_sentiment(spark, sf_dir):
    from .operators import enrich as E
    f = E.with_keyword_hits(_reviews_with_comment(spark, sf_dir).select("review_id", "comment"))
    return f.select("review_id", "comment", F.col("_pos").alias("positive_hits"),
                    F.col("_neg").alias("negative_hits"), E._label(F.col("_pos"), F.col("_neg")).alias("sentiment"),
                    E._score(F.col("_pos"), F.col("_neg")).alias("sentiment_score"))


@register("keyword_category", O.with_ctes(
    f"SELECT review_id, comment, {O.category('comment')} AS category, {O.key_issue('comment')} AS key_issue " + _RC))
def _keyword_category(spark, sf_dir):
    from .operators import enrich as E
    return _reviews_with_comment(spark, sf_dir).select(
        "review_id", "comment", E.category("comment").alias("category"), E.key_issue("comment").alias("key_issue"))


_ENRICH_SQL = (f"SELECT review_id, order_id, user_id, restaurant_id, rating, comment, review_date, "
               f"{O.sentiment('comment')} AS sentiment, {O.category('comment')} AS category, "
               f"{O.confidence('review_id')} AS confidence ")


@register("enrich_reviews", O.with_ctes(_ENRICH_SQL + _RC))
def _enrich_reviews(spark, sf_dir):
    from .operators import enrich as E
    return E.enrich_reviews(E.reviews_to_enrich(_models(spark, sf_dir).raw.reviews))


@register("review_enriched", O.with_ctes(
    f"SELECT review_id, sentiment_label, sentiment_score, topic, key_issue, model FROM review_enriched"))
def _review_enriched(spark, sf_dir):
    return _models(spark, sf_dir).review_enriched.drop("enriched_at")


def _done_before_cutoff(spark, sf_dir) -> DataFrame:
    """Reviews enriched by an earlier run: those dated before the cutoff."""
    from .operators import enrich as E
    raw = _models(spark, sf_dir).raw.reviews
    earlier = raw.where(F.col("comment").isNotNull() & (F.col("review_date") < F.lit(O.ENRICH_CUTOFF).cast("date")))
    return E.review_enriched(earlier).select(F.col("review_id").cast("bigint").alias("review_id"))


_NEW_ONLY = (f" AND NOT (review_date IS NOT NULL AND review_date < DATE '{O.ENRICH_CUTOFF}')")


@register("enrich_new_only", O.with_ctes(_ENRICH_SQL + _RC + _NEW_ONLY))
def _enrich_new_only(spark, sf_dir):
    from .operators import enrich as E
    raw = _models(spark, sf_dir).raw.reviews
    return E.enrich_reviews(E.reviews_to_enrich(raw, done=_done_before_cutoff(spark, sf_dir)))


@register("enrich_new_filtered", O.with_ctes(_ENRICH_SQL + _RC + _NEW_ONLY))
def _enrich_new_filtered(spark, sf_dir):
    """J5 with a key filter ahead of the anti join: only possible repeats are shuffled."""
    from .operators import enrich as E
    raw = _models(spark, sf_dir).raw.reviews
    return E.enrich_reviews(E.reviews_to_enrich(raw, done=_done_before_cutoff(spark, sf_dir), key_filter=True))


@register("enrich_stamped", O.with_ctes(
    "SELECT model, count(*) AS reviews, count(*) AS stamped, CAST(1 AS BIGINT) AS stamps, true AS in_this_run "
    "FROM review_enriched GROUP BY model"))
def _enrich_stamped(spark, sf_dir):
    """all rows of one run carry one time, the run's own."""
    from .operators import enrich as E
    done = E.review_enriched(_reviews_with_comment(spark, sf_dir))
    now = F.current_timestamp()
    return done.groupBy("model").agg(
        F.count(F.lit(1)).alias("reviews"), F.count("enriched_at").alias("stamped"),
        F.count_distinct("enriched_at").alias("stamps"),
        F.every(F.col("enriched_at").between(now - F.expr("INTERVAL 1 HOUR"), now)).alias("in_this_run"))


@register("enrich_batch", O.with_ctes(
    _ENRICH_SQL + _RC + _NEW_ONLY + " ORDER BY review_date ASC NULLS LAST, review_id LIMIT 5"))
def _enrich_batch(spark, sf_dir):
    from .operators import enrich as E
    raw = _models(spark, sf_dir).raw.reviews
    return E.enrich_reviews(E.reviews_to_enrich(raw, done=_done_before_cutoff(spark, sf_dir), batch_size=5))


@register("enrich_summary", O.with_ctes(
    f"SELECT count(*) AS total, count(CASE WHEN review_date < DATE '{O.ENRICH_CUTOFF}' THEN 1 END) AS skipped, "
    f"count(CASE WHEN NOT (review_date IS NOT NULL AND review_date < DATE '{O.ENRICH_CUTOFF}') THEN 1 END) "
    f"AS processed " + _RC))
def _enrich_summary(spark, sf_dir):
    from .operators import enrich as E
    return E.enrich_summary(_models(spark, sf_dir).raw.reviews, _done_before_cutoff(spark, sf_dir))


@register("enrich_documents", (
    f"SELECT doc_id, {O.sentiment('text')} AS sentiment, {O.category('text')} AS category, "
    f"{O.sentiment_score('text')} AS sentiment_score, {O.key_issue('text')} AS key_issue FROM documents"))
def _enrich_documents(spark, sf_dir):
    from .operators import enrich as E
    from .sources.fixtures import read_driver
    d = read_driver(spark, sf_dir, "documents").select("doc_id", "text")
    return E.classify_long_texts(d, "text").select("doc_id", "sentiment", "category", "sentiment_score", "key_issue")


@register("enrich_pluggable", O.with_ctes(
    f"SELECT review_id, {O.sentiment('comment')} AS sentiment, {O.category('comment')} AS category, "
    f"{O.confidence('review_id')} AS confidence " + _RC))
def _enrich_pluggable(spark, sf_dir):
    from .operators import enrich as E
    ok, _bad = E.split_rejects(E.enrich_with_model(_reviews_with_comment(spark, sf_dir), E.keyword_model))
    return ok


@register("parse_enrichment_json", O.with_ctes(
    "SELECT review_id, CASE WHEN json_valid(answer) THEN json_extract_string(answer, '$.sentiment') END AS sentiment, "
    "CASE WHEN json_valid(answer) THEN json_extract_string(answer, '$.category') END AS category, "
    "CASE WHEN json_valid(answer) THEN TRY_CAST(json_extract_string(answer, '$.confidence') AS DOUBLE) END "
    "AS confidence, NOT json_valid(answer) AS rejected FROM (SELECT review_id, CASE WHEN "
    f"{O.sentiment('comment')} = 'neutral' AND {O.category('comment')} = 'other' THEN {O.q(O.enrich.NO_ANSWER_TEXT)} "
    f"ELSE '{{\"sentiment\":\"' || {O.sentiment('comment')} || '\",\"category\":\"' || {O.category('comment')} "
    f"|| '\",\"confidence\":' || CAST({O.confidence('review_id')} AS VARCHAR) || '}}' END AS answer " + _RC + ") a"))
def _parse_enrichment_json(spark, sf_dir):
    """a model's JSON answers for every review, parsed; prose answers are rejected."""
    from .operators import enrich as E
    return E.parse_answers(E.model_answers(_reviews_with_comment(spark, sf_dir)))


def _answer_of_any_shape(label: str, cat: str, topic: str) -> str:
    """SQL of both engines: by review, an answer of either shape, one without a field, prose, a score in words, or none."""
    score = "CASE WHEN review_id % 2 = 0 THEN '0.25' ELSE '0.75' END"
    active = f"concat('{{\"sentiment\":\"', {label}, '\",\"category\":\"', {cat}, '\",\"confidence\":', {score}, ',\"more\":[1]}}')"
    mart = (f"concat('{{\"topic\":\"', {topic}, '\",\"sentiment_label\":\"', {label}, '\",\"sentiment_score\":-', {score}, "
            f"CASE WHEN review_id % 4 = 1 THEN ',\"key_issue\":null}}' ELSE ',\"key_issue\":\"cold food\"}}' END)")
    return (f"CASE CAST(review_id % 6 AS INT) WHEN 0 THEN {active} WHEN 1 THEN {mart} WHEN 2 THEN concat('{{\"sentiment\":\"', {label}, '\",\"confidence\":0.5}}') "
            f"WHEN 3 THEN {O.q(O.enrich.NO_ANSWER_TEXT)} WHEN 4 THEN replace({active}, {score}, '\"high\"') END")


_ANY_TOPIC = f"CASE category {' '.join(f'WHEN {O.q(k)} THEN {O.q(v)}' for k, v in O.enrich.TOPIC_BY_CATEGORY.items())} END"
_ANY_FIELD = "CASE WHEN json_valid(answer) THEN json_extract_string(answer, '$.{}') END AS {}"


@register("parse_answer_shapes", O.with_ctes(
    "SELECT review_id, shape, CASE shape WHEN 'active' THEN sentiment WHEN 'mart' THEN sentiment_label END AS sentiment, "
    f"CASE shape WHEN 'active' THEN {_ANY_TOPIC} WHEN 'mart' THEN topic END AS topic, "
    "CASE shape WHEN 'active' THEN TRY_CAST(confidence AS DOUBLE) WHEN 'mart' THEN TRY_CAST(sentiment_score AS DOUBLE) END AS score, "
    "CASE shape WHEN 'mart' THEN key_issue END AS key_issue, shape IS NULL AS rejected FROM (SELECT *, "
    "CASE WHEN sentiment IS NOT NULL AND category IS NOT NULL AND TRY_CAST(confidence AS DOUBLE) IS NOT NULL THEN 'active' "
    "WHEN sentiment_label IS NOT NULL AND topic IS NOT NULL AND TRY_CAST(sentiment_score AS DOUBLE) IS NOT NULL THEN 'mart' END AS shape "
    "FROM (SELECT review_id, " + ", ".join(_ANY_FIELD.format(f, f) for f in (
        "sentiment", "category", "confidence", "sentiment_label", "topic", "sentiment_score", "key_issue"))
    + " FROM (SELECT review_id, " + _answer_of_any_shape("label", "category", _ANY_TOPIC) + " AS answer FROM "
    + f"(SELECT review_id, {O.sentiment('comment')} AS label, {O.category('comment')} AS category " + _RC + ") c) a) f) g"))
def _parse_answer_shapes(spark, sf_dir):
    """Answers of either shape, with missing fields, prose, words for numbers and nulls."""
    from .operators import enrich as E
    said = E.classify(_reviews_with_comment(spark, sf_dir)).withColumnRenamed("sentiment", "label")
    return E.parse_any_answer(said.select("review_id", F.expr(_answer_of_any_shape("label", "category", _ANY_TOPIC)).alias("answer")))


@register("enrich_append", O.with_ctes(_ENRICH_SQL + f", '{O.enrich.KEYWORD_MODEL}' AS model " + _RC))
def _enrich_append(spark, sf_dir):
    """The enriched table is created by the first append; later runs add only new reviews."""
    from .plans.pipeline import append_new_enrichment
    from .session import scratch_path
    raw = _models(spark, sf_dir).raw.reviews
    path = scratch_path(spark, "review-ai-enriched")
    append_new_enrichment(spark, raw.where(F.col("review_date") < F.lit(O.ENRICH_CUTOFF).cast("date")), path, batch_id="1")
    append_new_enrichment(spark, raw, path, batch_id="2")          # the rest
    append_new_enrichment(spark, raw, path, batch_id="2")          # the same batch again: replaced, not repeated
    return append_new_enrichment(spark, raw, path, batch_id="3").drop("batch")   # nothing new


@register("mart_review_insights_active", O.with_ctes("SELECT * FROM mart_review_insights"))
def _mart_review_insights_active(spark, sf_dir):
    """The insight mart fed by the active enrichment shape through the bridge."""
    from .operators import enrich as E
    from .plans.marts import mart_review_insights
    m = _models(spark, sf_dir)
    active = E.enrich_reviews(E.reviews_to_enrich(m.raw.reviews))
    return mart_review_insights(E.active_to_mart_shape(active), m.stg_reviews)


# ------------------------------------------------------------- catalogue
def _catalogue(template_id: str):
    def fn(spark, sf_dir):
        from .operators.catalogue import run_template
        return comparable(run_template(_models(spark, sf_dir), template_id))
    return fn


for _tid, _sql in O.CATALOGUE_ORACLE.items():
    register(f"catalogue_{_tid}", O.with_ctes(_sql))(_catalogue(_tid))


def _conversations(spark, sf_dir, texts: list[str]) -> DataFrame:
    """The texts of all conversation turns, and one question or SQL text per turn besides, so that every rule has rows."""
    from .sources.fixtures import keyed_texts, read_driver
    return keyed_texts(read_driver(spark, sf_dir, "conversations"), texts)


@register("route_questions", (
    f"SELECT conv_id, turn, role, origin, {O.route('text')} AS template_id, {O.route('text', True)} AS template_id_plural "
    f"FROM {O.keyed_texts(QUESTION_TEXTS)}"))
def _route_questions(spark, sf_dir):
    from .operators.catalogue import route
    return _conversations(spark, sf_dir, QUESTION_TEXTS).select("conv_id", "turn", "role", "origin", route("text").alias("template_id"),
                                                route("text", True).alias("template_id_plural"))


def _asked_sql() -> str:
    """One row per question and result row: every routed report, its groups joined and its last column as the value."""
    from .operators.catalogue import REPORTS, ROUTES
    parts = []
    for tid, _ in ROUTES:
        by = ", ".join(REPORTS[tid].by)
        label = f"concat_ws(', ', {by})" if by else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT '{tid}' AS id, {label} AS label, CAST({REPORTS[tid].name} AS DOUBLE) AS value FROM ({O.CATALOGUE_ORACLE[tid]})")
    return O.with_ctes(
        f"SELECT c.conv_id, c.turn, c.origin, c.template_id, CASE WHEN c.template_id IS NULL THEN 'unroutable' ELSE 'answered' END AS status, r.label, r.value "
        f"FROM (SELECT conv_id, turn, origin, {O.route('text')} AS template_id FROM {O.keyed_texts(QUESTION_TEXTS)}) c "
        f"LEFT JOIN ({' UNION ALL '.join(parts)}) r ON r.id = c.template_id")


@register("ask_questions", _asked_sql())
def _ask_questions(spark, sf_dir):
    from .operators.catalogue import ask
    return ask(_models(spark, sf_dir), _conversations(spark, sf_dir, QUESTION_TEXTS), "text") \
        .select("conv_id", "turn", "origin", "template_id", "status", "label", "value")


@register("sql_safety", (
    f"SELECT conv_id, turn, origin, {O.is_safe('text')} AS is_safe, {O.is_safe_v1('text')} AS is_safe_v1 FROM {O.keyed_texts(SQL_TEXTS)}"))
def _sql_safety(spark, sf_dir):
    from .operators.catalogue import is_safe, is_safe_v1
    return _conversations(spark, sf_dir, SQL_TEXTS).select("conv_id", "turn", "origin", is_safe("text").alias("is_safe"),
                                                is_safe_v1("text").alias("is_safe_v1"))


@register("sql_safety_v1", f"SELECT conv_id, turn, origin, {O.is_safe_v1('text')} AS is_safe_v1 FROM {O.keyed_texts(SQL_TEXTS)}")
def _sql_safety_v1(spark, sf_dir):
    """The earlier filter, plain substring tests (it also rejects e.g. ``created_at``)."""
    from .operators.catalogue import is_safe_v1
    return _conversations(spark, sf_dir, SQL_TEXTS).select("conv_id", "turn", "origin", is_safe_v1("text").alias("is_safe_v1"))


@register("normalize_sql_text", f"SELECT conv_id, turn, origin, {O.normalize_sql('text')} AS sql_text FROM {O.keyed_texts(SQL_TEXTS)}")
def _normalize_sql_text(spark, sf_dir):
    from .operators.catalogue import normalize_sql_text
    return _conversations(spark, sf_dir, SQL_TEXTS).select("conv_id", "turn", "origin", normalize_sql_text("text").alias("sql_text"))


# ------------------------------------------------------------- retrieval
def _top(spark, sf_dir):
    from .operators import retrieval as R
    corpus = R.review_vectors(_models(spark, sf_dir).stg_reviews)
    questions = R.questions_frame(spark)
    return R.retrieve(corpus, questions), questions


@register("keyword_vector", O.with_ctes(
    f"SELECT review_id, {O.keyword_vector('comment')} AS embedding FROM stg_reviews WHERE comment IS NOT NULL"))
def _keyword_vector(spark, sf_dir):
    from .operators import retrieval as R
    return R.review_vectors(_models(spark, sf_dir).stg_reviews).select("review_id", "embedding")


@register("embed_pluggable", O.with_ctes(
    f"SELECT review_id, {O.keyword_vector('comment')} AS embedding FROM stg_reviews WHERE comment IS NOT NULL"))
def _embed_pluggable(spark, sf_dir):
    from .operators import retrieval as R
    texts = _models(spark, sf_dir).stg_reviews.where(F.col("comment").isNotNull())
    return R.embed_with_model(texts, "comment", R.keyword_batch, ["review_id"])


@register("cosine_similarity", O.with_retrieval("SELECT query_id, review_id, score FROM sc"))
def _cosine_similarity(spark, sf_dir):
    from .operators import retrieval as R
    corpus = R.review_vectors(_models(spark, sf_dir).stg_reviews)
    qv = R.questions_frame(spark).select("question_id", R.keyword_vector("question").alias("v"))
    return R.score_against_all(corpus, "review_id", "embedding", qv, "question_id", "v").select("query_id", "review_id", "score")


@register("cosine_best_question", O.with_retrieval(
    "SELECT review_id, first(query_id ORDER BY score DESC, query_id) AS query_id, max(score) AS score FROM sc GROUP BY review_id"))
def _cosine_best_question(spark, sf_dir):
    """One row per review: the question it answers best; equal vectors are scored once."""
    from .operators import retrieval as R
    corpus = R.review_vectors(_models(spark, sf_dir).stg_reviews)
    qv = R.questions_frame(spark).select("question_id", R.keyword_vector("question").alias("v"))
    return R.best_query_each(corpus, "review_id", "embedding", qv, "question_id", "v").select("review_id", "query_id", "score")


@register("retrieval_topk", O.with_retrieval("SELECT query_id, rank, review_id, city, rating, comment, score FROM top"))
def _retrieval_topk(spark, sf_dir):
    top, _ = _top(spark, sf_dir)
    return top.select("query_id", "rank", "review_id", "city", "rating", "comment", "score")


@register("retrieval_topk_model", O.with_retrieval("SELECT query_id, rank, review_id, city, rating, comment, score FROM top"))
def _retrieval_topk_model(spark, sf_dir):
    """The same retrieval with the caller's batch model embedding both sides."""
    from .operators import retrieval as R
    corpus = R.review_vectors(_models(spark, sf_dir).stg_reviews, R.keyword_batch)
    top = R.retrieve(corpus, R.questions_frame(spark), model=R.keyword_batch)
    return top.select("query_id", "rank", "review_id", "city", "rating", "comment", "score")


@register("answer_questions", O.with_retrieval(
    "SELECT qv.question_id, qv.question, " + O.answer_sql() + " AS answer FROM qv LEFT JOIN (SELECT query_id, "
    "count(*) AS n_top, count(CASE WHEN " + O.contains_any("lower(comment)", O.rt.ANSWER_DELIVERY_COMMENT)
    + " THEN 1 END) AS n_delivery, avg(rating) AS avg_rating FROM top GROUP BY query_id) a "
    "ON qv.question_id = a.query_id"))
def _answer_questions(spark, sf_dir):
    from .operators import retrieval as R
    top, questions = _top(spark, sf_dir)
    return R.answer_questions(top, questions)


@register("build_context", O.with_retrieval(
    "SELECT qv.question_id, qv.question, coalesce(c.context, '') AS context, "
    "'Question: ' || qv.question || chr(10) || chr(10) || 'Reviews:' || chr(10) || coalesce(c.context, '') AS prompt "
    "FROM qv LEFT JOIN (SELECT query_id, string_agg('(' || coalesce(city, 'None') || ', ' || coalesce(CAST(rating AS VARCHAR), 'None') "
    "|| ' stars) ' || comment || chr(10), '' ORDER BY rank) AS context FROM top GROUP BY query_id) c "
    "ON qv.question_id = c.query_id"))
def _build_context(spark, sf_dir):
    from .operators import retrieval as R
    top, questions = _top(spark, sf_dir)
    return R.build_context(top, questions)


@register("embedding_topk", (
    f"WITH {O.EMBED_CTES} SELECT CAST(query_id AS INTEGER) AS query_id, rank, vec_id, label, score FROM "
    f"(SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank "
    f"FROM esc) WHERE rank <= {5}"))
def _embedding_topk(spark, sf_dir):
    from .operators import retrieval as R
    from .sources.fixtures import read_driver
    return R.nearest_to_centroids(read_driver(spark, sf_dir, "embeddings"))


@register("embedding_cache", O.with_ctes(
    f"SELECT review_id, city, rating, CAST(comment AS VARCHAR) AS comment, {O.keyword_vector('comment')} AS embedding "
    "FROM stg_reviews WHERE comment IS NOT NULL"))
def _embedding_cache(spark, sf_dir):
    from .operators import retrieval as R
    from .session import scratch_path
    path = scratch_path(spark, "review-vectors")
    reviews = _models(spark, sf_dir).stg_reviews
    R.cached_vectors(spark, path, reviews.where(F.col("review_id") % 3 != 0), R.review_vectors)   # first call: embed and write
    return R.cached_vectors(spark, path, reviews, R.review_vectors)                               # later: embed the new ones only


@register("sample_rows", O.with_ctes(
    "SELECT * FROM stg_reviews ORDER BY md5('17:' || CAST(review_id AS VARCHAR)), review_id LIMIT 500"))
def _sample_rows(spark, sf_dir):
    from .operators.sampling import sample_rows
    return sample_rows(_models(spark, sf_dir).stg_reviews, 500, key="review_id")


# ------------------------------------------------------------- incremental facts
CUTOFF = "1998-06-01 00:00:00"
CUTOFF_LATER = "1999-06-01 00:00:00"


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


def _inc_table(spark, name: str, key: str, ts: str):
    from .operators.incremental import IncrementalTable
    from .session import scratch_path
    return IncrementalTable(spark, scratch_path(spark, name), key, ts)


_FCT_DEC = ["subtotal", "discount", "delivery_fee", "gst", "sales_amount"]


@register("fct_orders_incremental", O.with_ctes(f"SELECT {O.as_double(_FCT_DEC)} FROM fct_orders"))
def _fct_orders_incremental(spark, sf_dir):
    fct = _models(spark, sf_dir).fct_orders
    t = _inc_table(spark, "fct_orders", "order_id", "order_timestamp")
    t.run(fct.where(F.col("order_timestamp") < _ts(CUTOFF)))   # first run: full build
    t.run(fct)                                                 # later run: watermark + merge
    return comparable(t.read())


@register("fct_orders_partitioned", O.with_ctes(f"SELECT {O.as_double(_FCT_DEC)} FROM fct_orders"))
def _fct_orders_partitioned(spark, sf_dir):
    """The fact in one folder per year: each later run rewrites only the years its rows fall in."""
    from .operators.incremental import IncrementalTable
    from .session import scratch_path
    fct = _models(spark, sf_dir).fct_orders
    t = IncrementalTable(spark, scratch_path(spark, "fct_orders_by_year"), "order_id", "order_timestamp",
                         partition_by=["order_year"], keys_keep_partition=True)
    by_year = fct.withColumn("order_year", F.year("order_date"))
    for until in (CUTOFF, "1998-07-15 00:00:00", None, None):          # the last run finds nothing new
        t.run(by_year if until is None else by_year.where(F.col("order_timestamp") < _ts(until)))
    return comparable(t.read().select(*fct.columns))


@register("sample_rows_large", O.with_ctes(
    "SELECT * FROM stg_reviews ORDER BY md5('17:' || CAST(review_id AS VARCHAR)), review_id LIMIT 5000"))
def _sample_rows_large(spark, sf_dir):
    from .operators.sampling import sample_rows
    return sample_rows(_models(spark, sf_dir).stg_reviews, 5000, key="review_id")


@register("fct_order_items_incremental", O.with_ctes(f"SELECT {O.as_double(['price', 'line_amount'])} "
                                                     "FROM fct_order_items"))
def _fct_order_items_incremental(spark, sf_dir):
    fct = _models(spark, sf_dir).fct_order_items
    t = _inc_table(spark, "fct_order_items", "order_item_id", "order_ts")
    t.run(fct.where(F.col("order_ts") < _ts(CUTOFF)))
    t.run(fct)
    return comparable(t.read())


@register("incremental_filter", O.with_ctes(
    f"SELECT {O.as_double(_FCT_DEC)} FROM fct_orders WHERE order_timestamp > "
    f"(SELECT coalesce(max(order_timestamp), TIMESTAMP '1900-01-01') FROM fct_orders "
    f"WHERE order_timestamp < TIMESTAMP '{CUTOFF}')"))
def _incremental_filter(spark, sf_dir):
    from .operators.incremental import watermark_filter
    fct = _models(spark, sf_dir).fct_orders
    t = _inc_table(spark, "fct_orders_wm", "order_id", "order_timestamp")
    t.run(fct.where(F.col("order_timestamp") < _ts(CUTOFF)))
    return comparable(watermark_filter(fct, "order_timestamp", t.watermark()))


@register("fct_orders_upsert", O.with_ctes(
    f"SELECT * REPLACE (CAST(subtotal AS DOUBLE) AS subtotal, CAST(discount AS DOUBLE) AS discount, "
    f"CAST(CASE WHEN order_timestamp >= TIMESTAMP '{CUTOFF}' THEN delivery_fee + 1 ELSE delivery_fee END AS DOUBLE) "
    f"AS delivery_fee, CAST(gst AS DOUBLE) AS gst, CAST(sales_amount AS DOUBLE) AS sales_amount) FROM fct_orders"))
def _fct_orders_upsert(spark, sf_dir):
    fct = _models(spark, sf_dir).fct_orders
    t = _inc_table(spark, "fct_orders_upsert", "order_id", "order_timestamp")
    t.full_refresh(fct.where(F.col("order_timestamp") < _ts(CUTOFF_LATER)))
    changed = fct.where(F.col("order_timestamp") >= _ts(CUTOFF)).withColumn(
        "delivery_fee", (F.col("delivery_fee") + 1).cast("decimal(12,2)"))
    t.merge(changed)   # overlapping keys are updated, new keys inserted, others kept
    return comparable(t.read())


#: Yesterday's state: orders up to the cut-off, every fourth of them still "Placed"; the timestamps are those of today.
_PLACED = "CASE WHEN order_id % 4 = 0 THEN 'Placed' ELSE order_status END"


def _tracked_orders(spark, sf_dir):
    from .operators.incremental import IncrementalTable
    from .session import scratch_path
    fct = _models(spark, sf_dir).fct_orders
    t = IncrementalTable(spark, scratch_path(spark, "fct_orders_tracked"), "order_id", "order_timestamp", track_changes=True)
    t.run_changes(fct.where(F.col("order_timestamp") < _ts(CUTOFF)).withColumn("order_status", F.expr(_PLACED)))
    return t, fct


@register("fct_orders_changes", O.with_ctes(f"SELECT {O.as_double(_FCT_DEC)} FROM fct_orders"))
def _fct_orders_changes(spark, sf_dir):
    """Statuses that move on under an unchanged timestamp are merged, which no watermark would see."""
    t, fct = _tracked_orders(spark, sf_dir)
    t.run_changes(fct)
    t.run_changes(fct)                                         # nothing differs any more: nothing is written
    return comparable(t.read())


@register("change_classes", O.with_ctes(
    f"SELECT CASE WHEN order_timestamp >= TIMESTAMP '{CUTOFF}' THEN 'insert' WHEN order_status IS DISTINCT FROM {_PLACED} "
    f"THEN 'update' ELSE 'unchanged' END AS change, order_status, count(*) AS n FROM fct_orders GROUP BY ALL"))
def _change_classes(spark, sf_dir):
    """Source rows by change class and status against the stored table."""
    t, fct = _tracked_orders(spark, sf_dir)
    return t.changes(fct).groupBy("change", "order_status").agg(F.count("*").alias("n"))


@register("late_rows", O.with_ctes(
    f"SELECT {O.as_double(_FCT_DEC)} FROM fct_orders WHERE order_timestamp >= TIMESTAMP '{CUTOFF}'"))
def _late_rows(spark, sf_dir):
    fct = _models(spark, sf_dir).fct_orders
    t = _inc_table(spark, "fct_orders_late", "order_id", "order_timestamp")
    t.run(fct.where(F.col("order_timestamp") >= _ts(CUTOFF)))
    t.run(fct)   # rows older than the watermark arrive late and are not picked up
    return comparable(t.read())


_WM = f"(SELECT max(order_timestamp) FROM fct_orders WHERE order_timestamp < TIMESTAMP '{CUTOFF}')"


@register("schema_evolution", O.with_ctes(
    f"SELECT * REPLACE (CAST(subtotal AS DOUBLE) AS subtotal, CAST(discount AS DOUBLE) AS discount, "
    f"CAST(delivery_fee AS DOUBLE) AS delivery_fee, CAST(gst AS DOUBLE) AS gst, "
    f"CAST(sales_amount AS DOUBLE) AS sales_amount, "
    f"CASE WHEN order_timestamp <= {_WM} THEN NULL ELSE customer_rating END AS customer_rating, "
    f"CASE WHEN order_timestamp <= {_WM} THEN NULL ELSE delivery_time_min END AS delivery_time_min) FROM fct_orders"))
def _schema_evolution(spark, sf_dir):
    fct = _models(spark, sf_dir).fct_orders
    t = _inc_table(spark, "fct_orders_evolve", "order_id", "order_timestamp")
    t.run(fct.drop("customer_rating", "delivery_time_min").where(F.col("order_timestamp") < _ts(CUTOFF)))
    t.run(fct)   # two new source columns: appended, NULL for rows loaded before
    return comparable(t.read())


@register("merge_duplicate_keys", O.with_ctes(
    f"SELECT * REPLACE (CAST(subtotal AS DOUBLE) AS subtotal, CAST(discount AS DOUBLE) AS discount, "
    f"CAST(CASE WHEN order_timestamp >= TIMESTAMP '{CUTOFF}' THEN delivery_fee + 1 ELSE delivery_fee END AS DOUBLE) "
    f"AS delivery_fee, CAST(gst AS DOUBLE) AS gst, CAST(sales_amount AS DOUBLE) AS sales_amount, "
    f"CASE WHEN order_timestamp >= TIMESTAMP '{CUTOFF}' THEN order_timestamp + INTERVAL 1 MINUTE "
    f"ELSE order_timestamp END AS order_timestamp) FROM fct_orders"))
def _merge_duplicate_keys(spark, sf_dir):
    fct = _models(spark, sf_dir).fct_orders
    t = _inc_table(spark, "fct_orders_dups", "order_id", "order_timestamp")
    t.full_refresh(fct)
    recent = fct.where(F.col("order_timestamp") >= _ts(CUTOFF))
    newer = recent.withColumn("delivery_fee", (F.col("delivery_fee") + 1).cast("decimal(12,2)")).withColumn(
        "order_timestamp", F.timestamp_add("MINUTE", F.lit(1), F.col("order_timestamp")))
    t.merge(recent.unionByName(newer), on_duplicates="latest")   # each key twice: the newer row wins
    return comparable(t.read())


@register("merge_duplicates_refused", O.with_ctes(
    "SELECT city, count(*) AS orders, CAST(sum(delivery_fee) AS DOUBLE) AS fees, true AS refused FROM fct_orders GROUP BY city"))
def _merge_duplicates_refused(spark, sf_dir):
    """I3 in ``error`` mode: a batch that repeats keys of the table is refused and leaves the table as it was."""
    from .operators.incremental import DuplicateKeyError
    fct = _models(spark, sf_dir).fct_orders
    t = _inc_table(spark, "fct_orders_refused", "order_id", "order_timestamp")
    t.full_refresh(fct)
    recent = fct.where(F.col("order_timestamp") >= _ts(CUTOFF))
    newer = recent.withColumn("delivery_fee", (F.col("delivery_fee") + 1).cast("decimal(12,2)"))
    refused = False
    try:
        t.merge(recent.unionByName(newer), on_duplicates="error")
    except DuplicateKeyError:
        refused = True
    return comparable(t.read().groupBy("city").agg(F.count(F.lit(1)).alias("orders"), F.sum("delivery_fee").alias("fees"),
                                                   F.lit(refused).alias("refused")))


# ------------------------------------------------------------- ingestion
_RAW_ORDERS_DEC = ["subtotal", "discount", "delivery_fee", "gst", "sales_amount"]


@register("ingest_tolerant", O.with_ctes(
    f"SELECT {O.as_double(_RAW_ORDERS_DEC)} FROM raw_orders WHERE sales_amount IS NOT NULL"))
def _ingest_tolerant(spark, sf_dir):
    from .sources.files import copy_into, write_landing
    from .sources.raw import RAW_SCHEMAS
    from .session import scratch_path
    raw = _models(spark, sf_dir).raw.orders
    # The landing files spell a missing amount as "n/a", which does not parse: the
    # tolerant load skips those rows and keeps the rest.
    bad = raw.withColumn("sales_amount", F.coalesce(F.col("sales_amount").cast("string"), F.lit("n/a")))
    landing, table = scratch_path(spark, "landing-orders"), scratch_path(spark, "raw-orders")
    write_landing(bad, landing)
    copy_into(spark, landing, RAW_SCHEMAS["orders"], table, tolerant=True,
              rejects_path=scratch_path(spark, "rejects-orders"))
    return comparable(spark.read.parquet(table))


@register("ingest_strict", O.with_ctes(f"SELECT {O.as_double(_RAW_ORDERS_DEC)} FROM raw_orders"))
def _ingest_strict(spark, sf_dir):
    from .sources.files import copy_into, write_landing
    from .sources.raw import RAW_SCHEMAS
    from .session import scratch_path
    raw = _models(spark, sf_dir).raw.orders
    landing, table = scratch_path(spark, "landing-orders"), scratch_path(spark, "raw-orders")
    write_landing(raw, landing)
    copy_into(spark, landing, RAW_SCHEMAS["orders"], table, tolerant=False)
    return comparable(spark.read.parquet(table))


@register("ingest_incremental", O.with_ctes(f"SELECT {O.as_double(_RAW_ORDERS_DEC)} FROM raw_orders"))
def _ingest_incremental(spark, sf_dir):
    from .sources.files import write_landing
    from .sources.raw import RAW_SCHEMAS
    from .session import scratch_path
    from .streaming.ingest import ingest_new_files
    raw = _models(spark, sf_dir).raw.orders
    landing, table, ckpt = (scratch_path(spark, "landing-orders"), scratch_path(spark, "raw-orders"),
                            scratch_path(spark, "ckpt-orders"))
    early = F.col("order_timestamp") < _ts(CUTOFF)
    write_landing(raw.where(early), landing)           # day 1 files
    ingest_new_files(spark, landing, RAW_SCHEMAS["orders"], table, ckpt)
    write_landing(raw.where(~early), landing)          # day 2 files land next to them
    ingest_new_files(spark, landing, RAW_SCHEMAS["orders"], table, ckpt)
    ingest_new_files(spark, landing, RAW_SCHEMAS["orders"], table, ckpt)   # nothing new: no rows added
    return comparable(spark.read.schema(RAW_SCHEMAS["orders"]).parquet(table))


# ------------------------------------------------------------- daily pipeline
@register("pipeline_daily", O.with_ctes("SELECT * FROM mart_review_insights"))
def _pipeline_daily(spark, sf_dir):
    from .plans.pipeline import latest_table, run_daily
    from .session import scratch_path
    out = scratch_path(spark, "warehouse")
    run_daily(spark, _models(spark, sf_dir).raw, out, tests_severity="warn")   # rerun idempotence: tests/
    return latest_table(spark, out, "mart_review_insights")


# ------------------------------------------------------------- daily run from landing files
def _landing(spark, sf_dir) -> str:
    """The seven tables as landing files, with a bad line in each tolerant one."""
    from .plans.pipeline import TOLERANT
    from .sources.files import write_landing
    from .session import scratch_path
    root = scratch_path(spark, "landing")
    raw = _models(spark, sf_dir).raw
    for name in raw.names():
        write_landing(raw.get(name), f"{root}/{name}", compression="gzip")
        if name in TOLERANT:
            columns = RAW_SCHEMAS[name].fieldNames()
            lines = [",".join(columns), ",".join(["bad"] * (len(columns) + 3))]
            spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{root}/{name}")
    return root


@register("daily_from_landing", O.with_ctes(f"SELECT {O.as_double(['revenue'])} FROM mart_restaurant_performance"))
def _daily_from_landing(spark, sf_dir):
    from .plans.pipeline import latest_table, run_daily_from_landing
    from .session import scratch_path
    out = scratch_path(spark, "warehouse")
    run_daily_from_landing(spark, _landing(spark, sf_dir), out, tests_severity="warn")
    return comparable(latest_table(spark, out, "mart_restaurant_performance"))
