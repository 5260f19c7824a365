"""STAGING models: typed, cleaned views over RAW (M1-M7).

All are lazy DataFrame functions; nothing is materialised here. Lenient parses
use ``try_cast``; strict ones use ANSI ``cast``, which raises on bad input as
the warehouse's ``::`` cast does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import after_last_comma, first_number, initcap, null_if, try_decimal, try_number


def stg_restaurants(restaurants: DataFrame) -> DataFrame:
    # The id is cast strictly in the source model but only castable ids survive the
    # filter, so the lenient cast gives the same values whatever the filter order.
    rid = try_number("id")
    return restaurants.where(rid.isNotNull()).select(
        rid.alias("restaurant_id"),
        F.col("name").alias("restaurant_name"),
        after_last_comma("city").alias("city"),
        try_decimal(null_if("rating", "--"), 3, 1).alias("rating"),
        first_number("rating_count").alias("rating_count"),
        first_number("cost").alias("cost_for_two"),
        F.col("cuisine"),
        F.col("lic_no").alias("license_no"),
    )


def stg_users(users: DataFrame) -> DataFrame:
    uid = try_number("user_id")
    return users.where(uid.isNotNull()).select(
        uid.alias("customer_id"),
        F.col("name").alias("customer_name"),
        F.lower("email").alias("email"),
        try_number("age").alias("age"),
        "gender", "marital_status", "occupation",
        F.col("monthly_income").alias("income_band"),
        "education",
        try_number("family_size").alias("family_size"),
    )


def stg_food(food: DataFrame) -> DataFrame:
    return food.where(F.col("f_id").isNotNull()).select(
        "f_id",
        F.col("item").alias("food_name"),
        initcap("veg_or_non_veg").alias("veg_or_non_veg"),
    )


def stg_menu(menu: DataFrame) -> DataFrame:
    rid = try_number("r_id")
    price = try_decimal("price", 10, 2)
    return menu.where(rid.isNotNull() & (price > 0)).select(
        "menu_id", rid.alias("restaurant_id"), "f_id", "cuisine", price.alias("price"))


def stg_orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        "order_id", "order_timestamp", "order_date",
        F.col("user_id").alias("customer_id"),
        F.col("r_id").alias("restaurant_id"),
        after_last_comma("restaurant_city").alias("city"),
        "cuisine", "items_count", "sales_qty", "subtotal", "discount", "delivery_fee", "gst",
        "sales_amount", "currency", "payment_method", "order_status",
        (F.col("order_status") == "Delivered").alias("is_delivered"),
        "customer_rating", "delivery_time_min",
    )


def stg_order_items(order_items: DataFrame) -> DataFrame:
    return order_items.select(
        "order_item_id", "order_id",
        F.col("r_id").alias("restaurant_id"),
        "f_id",
        F.col("price").cast("decimal(10,2)").alias("price"),
        F.col("quantity").cast("decimal(38,0)").cast("bigint").alias("quantity"),
        F.col("line_amount").cast("decimal(10,2)").alias("line_amount"),
    )


def stg_reviews(reviews: DataFrame, restaurants_stg: DataFrame) -> DataFrame:
    """Reviews with the restaurant's city (left join; the text key is cast explicitly)."""
    r = reviews.where(F.col("comment").isNotNull())
    res = restaurants_stg.select(F.col("restaurant_id").alias("_rid"), F.col("city"))
    j = r.join(res, try_number(r["restaurant_id"]) == res["_rid"], "left")
    return j.select(
        "review_id", "order_id",
        F.col("user_id").cast("decimal(38,0)").cast("bigint").alias("customer_id"),
        F.col("restaurant_id").cast("string").alias("restaurant_id"),
        F.col("rating").cast("decimal(38,0)").cast("bigint").alias("rating"),
        F.col("comment").cast("string").alias("comment"),
        F.col("review_date").cast("date").alias("review_date"),
        "city",
    )
