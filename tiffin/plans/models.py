"""The model graph RAW -> STAGING -> MARTS as lazily built DataFrames.

``Models`` mirrors the project's ``ref()`` graph: each property builds its model
from upstream ones on first use. Nothing runs until an action.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import enrich
from ..sources.fixtures import raw_from_driver
from ..sources.raw import RawTables, scan_raw
from . import marts, staging


class Models:
    def __init__(self, spark: SparkSession, raw: RawTables, review_enriched: DataFrame | None = None):
        self.spark = spark
        self.raw = raw
        self._review_enriched = review_enriched

    @classmethod
    def from_driver(cls, spark: SparkSession, sf_dir: str) -> "Models":
        return cls(spark, raw_from_driver(spark, sf_dir))

    @classmethod
    def from_raw_dir(cls, spark: SparkSession, root: str) -> "Models":
        return cls(spark, scan_raw(spark, root))

    # staging (views)
    @cached_property
    def stg_restaurants(self) -> DataFrame:
        return staging.stg_restaurants(self.raw.restaurants)

    @cached_property
    def stg_users(self) -> DataFrame:
        return staging.stg_users(self.raw.users)

    @cached_property
    def stg_food(self) -> DataFrame:
        return staging.stg_food(self.raw.food)

    @cached_property
    def stg_menu(self) -> DataFrame:
        return staging.stg_menu(self.raw.menu)

    @cached_property
    def stg_orders(self) -> DataFrame:
        return staging.stg_orders(self.raw.orders)

    @cached_property
    def stg_order_items(self) -> DataFrame:
        return staging.stg_order_items(self.raw.order_items)

    @cached_property
    def stg_reviews(self) -> DataFrame:
        return staging.stg_reviews(self.raw.reviews, self.stg_restaurants)

    # dimensions and facts
    @cached_property
    def dim_customers(self) -> DataFrame:
        return marts.dim_customers(self.stg_users)

    @cached_property
    def dim_restaurants(self) -> DataFrame:
        return marts.dim_restaurants(self.stg_restaurants)

    @cached_property
    def dim_food(self) -> DataFrame:
        return marts.dim_food(self.stg_food)

    @cached_property
    def dim_date(self) -> DataFrame:
        return marts.dim_date(self.spark)

    @cached_property
    def fct_orders(self) -> DataFrame:
        return marts.fct_orders(self.stg_orders)

    @cached_property
    def fct_order_items(self) -> DataFrame:
        return marts.fct_order_items(self.stg_order_items, self.stg_orders)

    # marts
    @cached_property
    def mart_daily_city_revenue(self) -> DataFrame:
        return marts.mart_daily_city_revenue(self.fct_orders)

    @cached_property
    def mart_delivery_sla(self) -> DataFrame:
        return marts.mart_delivery_sla(self.fct_orders)

    @property
    def mart_delivery_value(self) -> DataFrame:
        return marts.mart_delivery_value(self.fct_orders)     # stages its values: built anew for every use

    @cached_property
    def mart_restaurant_performance(self) -> DataFrame:
        return marts.mart_restaurant_performance(self.fct_orders, self.dim_restaurants)

    @cached_property
    def review_enriched(self) -> DataFrame:
        """``ai.review_enriched``: given, or built with the keyword model from RAW reviews."""
        if self._review_enriched is not None:
            return self._review_enriched
        return enrich.review_enriched(self.raw.reviews.where("comment is not null"))

    @cached_property
    def mart_review_insights(self) -> DataFrame:
        return marts.mart_review_insights(self.review_enriched, self.stg_reviews)

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def pin(self, name: str, df: DataFrame) -> None:
        """Use ``df`` (e.g. the materialised table) for ``name`` in models built after this call."""
        self.__dict__[name] = df
