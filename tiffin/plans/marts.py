"""Dimensions, facts and aggregate marts.

Scale notes:
* Every mart is a single hash aggregation; Spark runs it partial-then-final, so a
  hot city sends one partial row per map task, not its rows.
* ``median`` / ``percentile`` are exact. Spark keeps a value -> count map per
  group, so memory follows the number of distinct delivery minutes, not rows.
* The restaurant mart aggregates orders per restaurant *before* joining the
  dimension, so the join sees one row per restaurant instead of every order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import div0, iff, try_number
from ..operators.quantiles import exact_percentiles


# ------------------------------------------------------------------ dimensions
def dim_customers(users_stg: DataFrame) -> DataFrame:
    age = F.col("age")
    segment = (F.when(age < 25, "Gen Z").when(age < 40, "Millennial").when(age < 55, "Gen X")
               .when(age.isNull(), "Unknown").otherwise("Boomer"))
    return users_stg.select("customer_id", "customer_name", "email", "age", segment.alias("age_segment"),
                            "gender", "marital_status", "occupation", "income_band", "education",
                            "family_size")


def dim_restaurants(restaurants_stg: DataFrame) -> DataFrame:
    return restaurants_stg.select("restaurant_id", "restaurant_name", "city", "cuisine", "rating",
                                  "rating_count", "cost_for_two")


def dim_food(food_stg: DataFrame) -> DataFrame:
    return food_stg.select("f_id", "food_name", "veg_or_non_veg")


def _calendar(days: DataFrame, col: str = "date_day") -> DataFrame:
    d = F.col(col)
    return days.select(
        d.alias("date_day"), F.year(d).alias("year"), F.month(d).alias("month"),
        F.monthname(d).alias("month_name"), F.dayname(d).alias("day_name"),
        # ISO day of week >= 6 (Saturday, Sunday); weekday() is 0 for Monday.
        (F.weekday(d) >= 5).alias("is_weekend"))


def dim_date(spark: SparkSession, start: str = "2024-01-01", rowcount: int = 1200,
             end: str = "2026-12-31") -> DataFrame:
    """The model's own spine: ``rowcount`` days from ``start``, cut at ``end``."""
    first = dt.date.fromisoformat(start)
    days = spark.range(rowcount).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date_day"))
    return _calendar(days.where(F.col("date_day") <= F.lit(dt.date.fromisoformat(end))))


def dim_date_covering(facts: DataFrame, date_col: str = "order_date", end: str | None = None) -> DataFrame:
    """Calendar spanning the first to the last date present in ``facts``, cut after the day ``end`` if one is given."""
    bounds = facts.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))
    days = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date_day"))
    if end is not None:
        days = days.where(F.col("date_day") <= F.lit(dt.date.fromisoformat(end)))
    return _calendar(days)


# ------------------------------------------------------------------ facts
FCT_ORDERS_COLUMNS = ["order_id", "order_timestamp", "order_date", "customer_id", "restaurant_id", "city",
                      "cuisine", "payment_method", "order_status", "is_delivered", "items_count", "sales_qty",
                      "subtotal", "discount", "delivery_fee", "gst", "sales_amount", "customer_rating",
                      "delivery_time_min"]


def fct_orders(orders_stg: DataFrame) -> DataFrame:
    return orders_stg.select(*FCT_ORDERS_COLUMNS)


def fct_order_items(items_stg: DataFrame, orders_stg: DataFrame) -> DataFrame:
    o = orders_stg.select("order_id", F.col("order_timestamp").alias("order_ts"), "order_date", "city")
    j = items_stg.join(o, "order_id", "inner")
    return j.select("order_item_id", "order_id", "restaurant_id", "f_id", "order_ts", "order_date", "city",
                    "price", "quantity", "line_amount")


# ------------------------------------------------------------------ marts
def mart_daily_city_revenue(fct: DataFrame) -> DataFrame:
    delivered = F.col("is_delivered")
    gmv = F.sum(iff(delivered, F.col("sales_amount"), F.lit(0)))
    n_delivered = F.count_if(delivered)
    return fct.groupBy("order_date", "city").agg(
        F.count(F.lit(1)).alias("orders"),
        n_delivered.alias("delivered_orders"),
        F.round(div0(F.count_if(F.col("order_status") == "Cancelled"), F.count(F.lit(1))), 4).alias("cancel_rate"),
        gmv.alias("gmv"),
        F.round(div0(gmv, n_delivered), 2).alias("aov"),
    )


def mart_delivery_sla(fct: DataFrame, approx_accuracy: int | None = None) -> DataFrame:
    """Exact interpolated p50 / p90 by default. ``approx_accuracy`` switches to
    ``percentile_approx`` (a fixed-size sketch per group) for measures whose
    distinct values, not just rows, are unbounded."""
    t = F.col("delivery_time_min")
    if approx_accuracy:
        p50 = F.percentile_approx(t, 0.5, approx_accuracy).cast("double")
        p90 = F.percentile_approx(t, 0.9, approx_accuracy).cast("double")
    else:
        p50, p90 = F.median(t), F.percentile(t, 0.9)
    return (fct.where(F.col("is_delivered"))
            .groupBy("city", F.hour("order_timestamp").alias("order_hour"))
            .agg(F.count_if(F.col("is_delivered")).alias("delivered_orders"),
                 F.round(p50, 1).alias("p50"),
                 F.round(p90, 1).alias("p90")))


def mart_delivery_value(fct: DataFrame) -> DataFrame:
    """The delivery mart for a measure with a value of its own for almost every order: amount per delivery minute.

    Exact p50 / p90 with bounded state per group (``operators.quantiles``).
    """
    keyed = fct.where(F.col("is_delivered")).withColumn("order_hour", F.hour("order_timestamp"))
    keys = ["city", "order_hour"]
    # div0 would call a delivery of 0 minutes free; it has no rate.
    rate = F.try_divide(F.col("sales_amount").cast("double"), F.col("delivery_time_min").cast("double"))
    ranks = exact_percentiles(keyed, keys, rate, {"p50": 0.5, "p90": 0.9})
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("delivered_orders"))
    same = counts["city"].eqNullSafe(ranks["city"]) & counts["order_hour"].eqNullSafe(ranks["order_hour"])
    return counts.join(ranks, same).select(counts["city"], counts["order_hour"], "delivered_orders",
                                           F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))


def mart_restaurant_performance(fct: DataFrame, restaurants_dim: DataFrame) -> DataFrame:
    # Partial results per restaurant first (sum/count pairs keep avg exact),
    # then the dimension join, then a final regroup over the model's four keys
    # (it also reproduces the fan-out if the dimension repeated an id).
    per_restaurant = fct.groupBy("restaurant_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(iff(F.col("is_delivered"), F.col("sales_amount"), F.lit(0))).alias("_rev"),
        F.sum("customer_rating").alias("_rs"), F.count("customer_rating").alias("_rn"),
        F.sum("delivery_time_min").alias("_ts"), F.count("delivery_time_min").alias("_tn"))
    dim = restaurants_dim.select("restaurant_id", "restaurant_name", "city", "cuisine")
    j = per_restaurant.join(dim, "restaurant_id", "left")
    return j.groupBy("restaurant_id", "restaurant_name", "city", "cuisine").agg(
        F.sum("_n").alias("orders"),
        F.sum("_rev").alias("revenue"),
        F.round(F.sum("_rs").cast("double") / F.sum("_rn"), 2).alias("avg_customer_rating"),
        F.round(F.sum("_ts").cast("double") / F.sum("_tn"), 1).alias("avg_delivery_min"),
    )


def mart_review_insights(review_enriched: DataFrame, reviews_stg: DataFrame) -> DataFrame:
    e = review_enriched.select(try_number("review_id").alias("review_id"), "topic", "sentiment_label",
                               "sentiment_score", "key_issue")
    rr = reviews_stg.select("review_id", "city", "rating")
    j = e.join(rr, "review_id", "inner")
    return j.groupBy("city", "topic", "sentiment_label").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.round(F.avg("sentiment_score"), 3).alias("avg_sentiment_score"),
        F.round(F.avg("rating"), 2).alias("avg_star_rating"),
        F.count_if(F.col("key_issue").isNotNull()).alias("flagged_issues"),
    )
