from decimal import Decimal

from pyspark.sql import functions as F

from tiffin.functions import columns as C


def one(spark, values, expr, schema="s string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_try_number_rounds_and_rejects(spark):
    assert one(spark, ["12", "12.7", "N/A", None, "", "-3"], C.try_number("s")) == [12, 13, None, None, None, -3]
    assert one(spark, ["9" * 20, "9" * 38, "9" * 60, "9223372036854775807"], C.try_number("s")) == [None, None, None, 9223372036854775807]
    assert one(spark, ["12345678901234567890+ ratings"], C.first_number("s")) == [None]


def test_try_decimal_half_up_and_overflow(spark):
    out = one(spark, ["4.25", "4.2", "100.5", "--", None], C.try_decimal("s", 3, 1))
    assert out == [Decimal("4.3"), Decimal("4.2"), None, None, None]


def test_city_after_last_comma(spark):
    out = one(spark, ["Area,City", "City", "City,", "A, B ,  City", None], C.after_last_comma("s"))
    assert out == ["City", "City", "City,", "City", None]


def test_first_number(spark):
    out = one(spark, ["50+ ratings", "Too Few Ratings", "₹ 200", "₹ 1,200", None], C.first_number("s"))
    assert out == [50, None, 200, 1, None]


def test_initcap_breaks_on_punctuation_not_apostrophe(spark):
    out = one(spark, ["non-veg", "NON VEG", "veg/non_veg", "o'neil x-y", None, ""], C.initcap("s"))
    assert out == ["Non-Veg", "Non Veg", "Veg/Non_Veg", "O'neil X-Y", None, ""]


def test_null_if(spark):
    assert one(spark, ["--", "4.1", None], C.null_if("s", "--")) == [None, "4.1", None]


def test_div0(spark):
    df = spark.createDataFrame([(1, 0), (1, 4), (0, 0)], "a long, b long")
    assert [r[0] for r in df.select(C.div0("a", "b")).collect()] == [0.0, 0.25, 0.0]


def test_contains_any_and_count(spark):
    df = spark.createDataFrame([("the plate was hot",), ("nothing",)], "s string")
    out = df.select(C.contains_any(F.col("s"), ["late", "x"]), C.count_contained(F.col("s"), ["late", "hot", "z"]))
    assert [tuple(r) for r in out.collect()] == [(True, 2), (False, 0)]


def test_cosine_zero_vector(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [1.0, 0.0])],
                               "a array<double>, b array<double>")
    out = [round(r[0], 12) for r in df.select(C.cosine("a", "b")).collect()]
    assert out == [1.0, 0.0, round(2 ** -0.5, 12)]


def test_scale_settings():
    from tiffin.session import scale_settings
    conf = scale_settings(100 * 2 ** 40, 8000)          # 100 TB on 1000 executors x 8 cores
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    assert int(scale_settings(10 * 2 ** 20, 8)["spark.sql.shuffle.partitions"]) == 16
