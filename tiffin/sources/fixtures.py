"""Adapter: the driver's order-shaped tables -> the seven RAW food-delivery tables.

The messy text the staging models must clean (junk ids, '--' ratings, '₹ 200',
'Area, City' strings, lenient numbers, NULLs) is derived deterministically from
each row's key, so the same rules can be restated in SQL for the oracle
(``tiffin.oracle.sql``). Every derived table grows with its driver table.

Sums are taken over DECIMAL values so they do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .raw import RAW_SCHEMAS, RawTables

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# ---------------------------------------------------------------------------
# Fixed values of the adapter (our own choice; they only shape test data).
# ---------------------------------------------------------------------------
PAYMENT_BY_PRIORITY = {
    "1-URGENT": "UPI",
    "2-HIGH": "Credit Card",
    "3-MEDIUM": "Cash on Delivery",
    "4-NOT SPECIFIED": "Wallet",
    "5-LOW": "Debit Card",
}
STATUS_BY_CODE = {"F": "Delivered", "O": "Cancelled", "P": "Refunded"}
CUISINES = ["North Indian", "Chinese", "South Indian", "Italian", "Fast Food"]
MARITAL = ["Single", "Married", "Prefer not to say"]
OCCUPATIONS = ["Student", "Employee", "Self Employeed", "House wife"]
INCOME_BANDS = ["No Income", "Below Rs.10000", "10001 to 25000", "25001 to 50000", "More than 50000"]
EDUCATION = ["Graduate", "Post Graduate", "Ph.D", "School", "Uneducated"]
VEG_LABELS = ["veg", "non-veg", "NON VEG", "veg/non_veg", None]
# Review comments. They include the substring traps of the keyword classifier
# ("plate" holds "late", "breakfast" holds "fast", "unhappy" holds "happy"), a tie,
# a phrase with no keyword and one phrase per category. Every phrase has 0, 1, 2 or 4
# keyword hits, or hits on one side only, so sentiment scores are exact binary fractions.
REVIEW_PHRASES = [
    "great food, served on a clean plate",
    "the breakfast arrived cold",
    "i was unhappy with the order",
    "delivery was not on time",
    "delicious and fresh biryani",
    "the packaging was torn and dirty",
    "staff were rude",
    "too expensive for the portion",
    "okay experience overall",
    "amazing taste but the rider was late",
    "friendly waiter and good value",
    "wrong items and missing cutlery, worst order",
    "cheap and tasty",
    "slow delivery, food was bad and cold",
    "nice eco-friendly package",
    "good food but delay in delivery",
    "awesome",
    "terrible, awful and horrible experience, very disappointed",
    "love it, perfect, wonderful, excellent",
    "great taste, poor packaging",
    "GREAT Service",
]
# Ends of comments: words of the retrieval vector, none of the classifier's positive or negative ones, so scores stay exact.
REVIEW_ENDINGS = ["", "; table service", "; again from this restaurant", "; packaging as usual", "; the staff knew us", "; portion and price as listed", "; taste of home", "; delivery by bike"]


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Texts for the question catalogue, picked by key: every route and none, "cities", spelling
# and white space; and SQL texts for every branch of the safety checks and the normaliser.
QUESTION_TEXTS = [
    "Which city has the highest GMV?", "Which cuisine gets the most orders?", "What is the delivery time in each city?",
    "How often do people cancel by payment method?", "Which restaurant earns the most revenue?", "What is the AOV?",
    "average order value please", "Where is cancellation worst, by city?", "Show orders by payment method", "Average delivery minutes?",
    "avg delivery", "Which cuisine brings the most revenue?", "orders per city", "How many orders are there?", "  ORDERS \n", "Total Orders",
    "GMV over all cities", "cancellation in big cities", "orders in the cities", "delivery time across cities", "What is the weather?", "",
    "Orders!", "city and gmv and cuisine most orders",
]
SQL_TEXTS = [
    "SELECT city FROM TIFFIN.MARTS.FCT_ORDERS", "  select 1;", "with x as (select 1) select * from x", "SELECT 1; SELECT 2", "select 1;;;",
    "DELETE FROM TIFFIN.FCT_ORDERS", "select * from t -- drop table t", "select 1 -- a; b\nfrom t", "-- note\nselect 1", "select /* drop */ 1",
    "select /* fine */ 1", "select created_at from t", "select drop_off from t", "select updated from t", "select 'x' as replace from t",
    "select a from t where b = 'grant'", "SELECT Insert_ts FROM t", "selection of rows", "without", "explain select 1", "", "  ",
    "select 1\n;\n", "Select\tTRUNCATE(1.5)", "select revoke\u00e9 from t", "TIFFIN.MARTS.TIFFIN.X;", "tiffin.marts.x", "update t set a = 1",
]


def keyed_texts(conversations: DataFrame, texts: list[str]) -> DataFrame:
    """Every conversation turn twice: with its own text (origin ``given``), and with one of ``texts`` chosen by
    conversation and turn (``keyed``), so that every rule has rows."""
    keyed = conversations.withColumn("text", pick((F.col("conv_id") * 7 + F.col("turn")) % len(texts), texts))
    return conversations.withColumn("origin", F.lit("given")).unionByName(keyed.withColumn("origin", F.lit("keyed")))


def pick(index: Column, values: list) -> Column:
    """``values[index]`` for a 0-based integer Column (fixed list lookup)."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index + 1).cast("int"))


def messy_city(k: Column, name: Column) -> Column:
    """City text in the shapes the source system delivers ('City', 'City,', 'A, B ,  City')."""
    v = k % 5
    return (F.when(k % 43 == 0, F.lit(None).cast("string"))
            .when(v == 1, F.concat(name, F.lit(",")))
            .when(v == 2, F.concat(F.lit("Area 1, Zone ,  "), name))
            .when(v == 3, F.concat(F.lit("Sector "), (k % 7).cast("string"), F.lit(", "), name))
            .otherwise(name))


def _map(col: Column, mapping: dict) -> Column:
    out = None
    for src, dst in mapping.items():
        out = (F.when(col == src, F.lit(dst)) if out is None else out.when(col == src, F.lit(dst)))
    return out


def _money(c: Column) -> Column:
    return c.cast("decimal(12,2)")


def _units(total: Column, scale: int) -> Column:
    """A long count of 10^-scale units as DECIMAL(12,2), rounded half up."""
    return (total.cast("decimal(20,0)") / F.lit(10 ** scale).cast(f"decimal({scale + 1},0)")).cast("decimal(12,2)")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The key is renamed below the joins: Spark's runtime filters (``operators.incremental``) follow a join key down by its name only.
    o = read_driver(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "order_id")
    c = read_driver(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read_driver(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    li = read_driver(spark, sf_dir, "lineitem")
    # Money is summed in exact integer units (cents; cents x percent points for the
    # discount and tax products) held in longs, then turned into DECIMAL(12,2) once
    # per order. Summing DECIMAL(12,2) directly widens past 18 digits, where Spark
    # keeps each partial sum as a BigDecimal object.
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    lines = li.groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("r_id"),
        F.count(F.lit(1)).alias("items_count"),
        F.sum("l_quantity").alias("sales_qty"),
        F.sum(cents).alias("_sub"),
        F.sum(cents * F.round(F.col("l_discount") * 100).cast("bigint")).alias("_disc"),
        F.sum(cents * F.round(F.col("l_tax") * 100).cast("bigint")).alias("_gst"))
    lines = lines.select("l_orderkey", "r_id", "items_count", "sales_qty",
                         _units(F.col("_sub"), 2).alias("subtotal"), _units(F.col("_disc"), 4).alias("discount"),
                         _units(F.col("_gst"), 4).alias("gst"))
    k = F.col("order_id")
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
          .join(n, F.col("c_nationkey") == n.n_nationkey, "left")
          .join(lines, k == lines.l_orderkey, "left"))
    status = _map(F.col("o_orderstatus"), STATUS_BY_CODE)
    return j.select(
        k,
        F.timestamp_add("HOUR", k % 24, F.col("o_orderdate")).alias("order_timestamp"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("o_custkey").alias("user_id"),
        F.col("r_id"),
        messy_city(k, F.col("n_name")).alias("restaurant_city"),
        F.when(k % 23 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("cuisine"),
        F.coalesce(F.col("items_count"), F.lit(0)).cast("bigint").alias("items_count"),
        F.coalesce(F.col("sales_qty"), F.lit(0.0)).alias("sales_qty"),
        _money(F.col("subtotal")).alias("subtotal"),
        _money(F.col("discount")).alias("discount"),
        _money(k % 50).alias("delivery_fee"),
        _money(F.col("gst")).alias("gst"),
        F.when(k % 41 == 0, F.lit(None)).otherwise(_money(F.col("o_totalprice"))).alias("sales_amount"),
        F.lit("INR").alias("currency"),
        _map(F.col("o_orderpriority"), PAYMENT_BY_PRIORITY).alias("payment_method"),
        F.when(k % 59 == 0, F.lit(None)).when(k % 53 == 0, F.lit("Pending")).otherwise(status)
         .alias("order_status"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(1 + k % 5).cast("bigint").alias("customer_rating"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(15 + (k * 37) % 61).cast("bigint")
         .alias("delivery_time_min"),
    )


def raw_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_driver(spark, sf_dir, "lineitem")
    p = read_driver(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    j = li.join(p, li.l_partkey == p.p_partkey, "left")
    return j.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    F.date_format("l_shipdate", "yyyyMMdd")).alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_suppkey").alias("r_id"),
        F.concat(F.lit("fd"), F.col("l_partkey").cast("string")).alias("f_id"),
        F.col("p_retailprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("line_amount"),
    )


def raw_restaurants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_driver(spark, sf_dir, "supplier")
    n = read_driver(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("s_suppkey")
    ks = k.cast("string")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
        F.when(k % 17 == 0, F.lit("N/A")).otherwise(ks).alias("id"),
        F.col("s_name").alias("name"),
        messy_city(k, F.col("n_name")).alias("city"),
        F.when(k % 6 == 0, F.lit("--"))
         .when(k % 6 == 1, F.concat((1 + k % 4).cast("string"), F.lit("."), (k % 10).cast("string"), F.lit("5")))
         .otherwise(F.concat((1 + k % 4).cast("string"), F.lit("."), (k % 10).cast("string")))
         .alias("rating"),
        F.when(k % 3 == 0, F.lit("Too Few Ratings"))
         .otherwise(F.concat((k % 500).cast("string"), F.lit("+ ratings"))).alias("rating_count"),
        F.when(k % 9 == 0, F.lit("₹ 1,200"))
         .otherwise(F.concat(F.lit("₹ "), (100 + 50 * (k % 20)).cast("string"))).alias("cost"),
        pick(k % 5, CUISINES).alias("cuisine"),
        F.concat(F.lit("LIC"), F.lpad(((k * 7919) % 100000).cast("string"), 5, "0")).alias("lic_no"),
    )


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_driver(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.when(k % 31 == 0, F.concat(F.lit("u"), k.cast("string"))).otherwise(k.cast("string")).alias("user_id"),
        F.col("c_name").alias("name"),
        F.concat(F.col("c_name"), F.lit("@Mail.Example")).alias("email"),
        F.when(k % 13 == 0, F.lit("unknown")).when(k % 13 == 1, F.lit(None))
         .otherwise((18 + (k * 7) % 60).cast("string")).alias("age"),
        F.when(k % 2 == 0, F.lit("Male")).otherwise(F.lit("Female")).alias("gender"),
        pick(k % 3, MARITAL).alias("marital_status"),
        pick(k % 4, OCCUPATIONS).alias("occupation"),
        pick(k % 5, INCOME_BANDS).alias("monthly_income"),
        pick((k * 3 + 1) % 5, EDUCATION).alias("education"),
        F.when(k % 10 == 0, F.lit("")).otherwise((1 + k % 6).cast("string")).alias("family_size"),
    )


def raw_food(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_driver(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        F.when(k % 19 == 0, F.lit(None)).otherwise(F.concat(F.lit("fd"), k.cast("string"))).alias("f_id"),
        F.col("p_name").alias("item"),
        pick(k % 5, VEG_LABELS).alias("veg_or_non_veg"),
    )


def raw_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_driver(spark, sf_dir, "part")
    k = F.col("p_partkey")
    v = k % 11
    return p.select(
        F.concat(F.lit("m"), k.cast("string")).alias("menu_id"),
        F.when(k % 13 == 0, F.lit("abc")).otherwise((k % 97).cast("string")).alias("r_id"),
        F.concat(F.lit("fd"), k.cast("string")).alias("f_id"),
        pick(k % 5, CUISINES).alias("cuisine"),
        F.when(v == 0, F.lit("free")).when(v == 1, F.lit("0")).when(v == 2, F.lit("-5"))
         .when(v == 3, F.lit(None))
         .otherwise(F.concat((100 + (k * 13) % 900).cast("string"), F.lit(".50"))).alias("price"),
    )


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per order (restaurant id kept as text): orders and the first supplier of their lines, nothing else."""
    o = read_driver(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), "o_custkey", "o_orderdate")
    first = read_driver(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.min("l_suppkey").alias("r_id"))
    k = F.col("order_id")
    return o.join(first, "order_id", "left").select(
        k.alias("review_id"),
        k.alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("r_id").cast("string").alias("restaurant_id"),
        F.when(k % 37 == 0, F.lit(None)).otherwise(1 + (k * 7) % 5).cast("bigint").alias("rating"),
        F.when(k % 29 == 0, F.lit(None)).otherwise(F.concat(
            pick(k % len(REVIEW_PHRASES), REVIEW_PHRASES), pick(F.expr("order_id div 3") % len(REVIEW_ENDINGS), REVIEW_ENDINGS))).alias("comment"),
        F.when(k % 31 == 0, F.lit(None)).otherwise(F.to_date("o_orderdate")).alias("review_date"),
    )


def _conform(df: DataFrame, name: str) -> DataFrame:
    """Cast to the declared RAW schema (column order and types)."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMAS[name].fields])


class DriverRaw(RawTables):
    """RAW tables derived from the driver's tables, each built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):  # noqa: D107 - lazy, no dataclass init
        self._spark, self._dir, self._built = spark, sf_dir, {}

    def get(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = _conform(globals()[f"raw_{name}"](self._spark, self._dir), name)
        return self._built[name]

    def names(self) -> list[str]:
        return list(RAW_SCHEMAS)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in RAW_SCHEMAS:
            raise AttributeError(name)
        return self.get(name)


def raw_from_driver(spark: SparkSession, sf_dir: str) -> RawTables:
    return DriverRaw(spark, sf_dir)
