"""RAW layer: the seven landed tables and the enrichment source.

Raw column types are not declared by the source system; they follow from how
staging parses them. Columns parsed leniently are text.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, L, D = T.StringType(), T.LongType(), T.DoubleType()


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


MONEY = T.DecimalType(12, 2)

RAW_SCHEMAS: dict[str, T.StructType] = {
    "restaurants": _schema(("id", S), ("name", S), ("city", S), ("rating", S), ("rating_count", S),
                           ("cost", S), ("cuisine", S), ("lic_no", S)),
    "users": _schema(("user_id", S), ("name", S), ("email", S), ("age", S), ("gender", S),
                     ("marital_status", S), ("occupation", S), ("monthly_income", S),
                     ("education", S), ("family_size", S)),
    "food": _schema(("f_id", S), ("item", S), ("veg_or_non_veg", S)),
    "menu": _schema(("menu_id", S), ("r_id", S), ("f_id", S), ("cuisine", S), ("price", S)),
    "orders": _schema(("order_id", L), ("order_timestamp", T.TimestampNTZType()), ("order_date", T.DateType()),
                      ("user_id", L), ("r_id", L), ("restaurant_city", S), ("cuisine", S),
                      ("items_count", L), ("sales_qty", D), ("subtotal", MONEY), ("discount", MONEY),
                      ("delivery_fee", MONEY), ("gst", MONEY), ("sales_amount", MONEY), ("currency", S),
                      ("payment_method", S), ("order_status", S), ("customer_rating", L),
                      ("delivery_time_min", L)),
    "order_items": _schema(("order_item_id", S), ("order_id", L), ("r_id", L), ("f_id", S),
                           ("price", D), ("quantity", D), ("line_amount", D)),
    "reviews": _schema(("review_id", L), ("order_id", L), ("user_id", L), ("restaurant_id", S),
                       ("rating", L), ("comment", S), ("review_date", T.DateType())),
}

# Mart-shaped enrichment source (``ai.review_enriched``).
REVIEW_ENRICHED_SCHEMA = _schema(("review_id", S), ("sentiment_label", S), ("sentiment_score", D),
                                 ("topic", S), ("key_issue", S), ("model", S),
                                 ("enriched_at", T.TimestampType()))


@dataclass
class RawTables:
    """The RAW schema as DataFrames (named source scan, S4)."""
    restaurants: DataFrame
    users: DataFrame
    food: DataFrame
    menu: DataFrame
    orders: DataFrame
    order_items: DataFrame
    reviews: DataFrame

    def names(self) -> list[str]:
        return [f.name for f in fields(self)]

    def get(self, name: str) -> DataFrame:
        return getattr(self, name)


def scan_raw(spark: SparkSession, root: str) -> RawTables:
    """Read a RAW schema stored as one Parquet folder per table under ``root``."""
    return RawTables(**{n: spark.read.schema(s).parquet(f"{root.rstrip('/')}/{n}")
                        for n, s in RAW_SCHEMAS.items()})


def write_raw(raw: RawTables, root: str, mode: str = "overwrite") -> None:
    for n in raw.names():
        raw.get(n).write.mode(mode).parquet(f"{root.rstrip('/')}/{n}")
