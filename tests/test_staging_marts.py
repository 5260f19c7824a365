import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tiffin.plans import marts, staging
from tiffin.sources.raw import RAW_SCHEMAS


def raw(spark, name, rows):
    return spark.createDataFrame(rows, RAW_SCHEMAS[name])


def test_stg_restaurants_cleaning(spark):
    rows = [("12", "A", "Area,Pune", "4.25", "50+ ratings", "₹ 200", "Cafe", "L1"),
            ("N/A", "B", "Pune", "4.0", None, None, "Cafe", "L2"),
            ("13", "C", "Goa,", "--", "Too Few Ratings", "₹ 1,200", "Bar", "L3")]
    out = {r.restaurant_id: r for r in staging.stg_restaurants(raw(spark, "restaurants", rows)).collect()}
    assert set(out) == {12, 13}
    assert out[12].city == "Pune" and out[12].rating == Decimal("4.3") and out[12].rating_count == 50
    assert out[12].cost_for_two == 200
    assert out[13].city == "Goa," and out[13].rating is None and out[13].rating_count is None
    assert out[13].cost_for_two == 1


def test_stg_users_and_age_segments(spark):
    rows = [(u, "n", "A@B.COM", age, "M", "S", "O", "I", "E", fam)
            for u, age, fam in [("1", "24", "4"), ("2", "25", ""), ("3", "40", "1"), ("4", "55", "2"),
                                ("5", "unknown", "3"), ("6", None, "3"), ("x", "30", "1"), ("7", "54", "1")]]
    users = staging.stg_users(raw(spark, "users", rows))
    seg = {r.customer_id: r.age_segment for r in marts.dim_customers(users).collect()}
    assert seg == {1: "Gen Z", 2: "Millennial", 3: "Gen X", 4: "Boomer", 5: "Unknown", 6: "Unknown", 7: "Gen X"}
    assert users.where("customer_id = 2").first().family_size is None
    assert users.first().email == "a@b.com"


def test_stg_menu_filters(spark):
    rows = [("m1", "12", "f", "c", "40.0"), ("m2", "abc", "f", "c", "40"), ("m3", "5", "f", "c", "0"),
            ("m4", "5", "f", "c", "-5"), ("m5", "5", "f", "c", "free"), ("m6", "5", "f", "c", None)]
    out = staging.stg_menu(raw(spark, "menu", rows)).collect()
    assert [(r.menu_id, r.restaurant_id, r.price) for r in out] == [("m1", 12, Decimal("40.00"))]


def test_stg_food_initcap_and_key(spark):
    rows = [("f1", "x", "non-veg"), (None, "y", "veg"), ("f3", "z", None)]
    out = staging.stg_food(raw(spark, "food", rows)).collect()
    assert [(r.f_id, r.veg_or_non_veg) for r in out] == [("f1", "Non-Veg"), ("f3", None)]


def _orders(spark, rows):
    full = []
    for oid, ts, city, status, amount, minutes, rid, rating in rows:
        full.append((oid, ts, ts.date(), 1, rid, city, "c", 1, 1.0, None, None, None, None,
                     None if amount is None else Decimal(amount), "INR", "UPI", status, rating, minutes))
    return raw(spark, "orders", full)


def test_daily_city_revenue_div0_and_nulls(spark):
    t = dt.datetime(2024, 1, 1, 10)
    o = _orders(spark, [
        (1, t, "X, Pune", "Delivered", "100.00", 10, 1, 5),
        (2, t, "Pune", "Delivered", "50.01", 20, 1, None),
        (3, t, "Pune", "Cancelled", "10.00", None, 1, 1),
        (4, t, "Goa", "Cancelled", "10.00", None, 2, 1),
        (5, t, "Goa", None, "10.00", None, 2, 1),
    ])
    m = {r.city: r for r in marts.mart_daily_city_revenue(marts.fct_orders(staging.stg_orders(o))).collect()}
    assert m["Pune"].orders == 3 and m["Pune"].delivered_orders == 2
    assert m["Pune"].cancel_rate == 0.3333 and m["Pune"].gmv == Decimal("150.01")
    assert m["Pune"].aov == Decimal("75.01")          # 75.005 rounds half up
    assert m["Goa"].delivered_orders == 0 and m["Goa"].aov == 0 and m["Goa"].gmv == 0
    assert m["Goa"].cancel_rate == 0.5


def test_delivery_sla_interpolates(spark):
    t = dt.datetime(2024, 1, 1, 9)
    o = _orders(spark, [(i, t, "Pune", "Delivered", "1.00", m, 1, 1) for i, m in enumerate([10, 20, 30, 40])]
                + [(9, t, "Pune", "Cancelled", "1.00", 99, 1, 1)])
    r = marts.mart_delivery_sla(marts.fct_orders(staging.stg_orders(o))).first()
    assert (r.city, r.order_hour, r.delivered_orders, r.p50, r.p90) == ("Pune", 9, 4, 25.0, 37.0)


def test_restaurant_performance_uses_dimension_city(spark):
    t = dt.datetime(2024, 1, 1, 9)
    o = _orders(spark, [(1, t, "Order City", "Delivered", "10.00", 10, 7, 4),
                        (2, t, "Order City", "Cancelled", "5.00", 20, 7, 3),
                        (3, t, "Order City", "Delivered", "5.00", None, None, None)])
    dim = spark.createDataFrame([(7, "R7", "Dim City", "Thai", None, None, None)],
                                "restaurant_id long, restaurant_name string, city string, cuisine string, "
                                "rating decimal(3,1), rating_count long, cost_for_two long")
    out = {r.restaurant_id: r for r in marts.mart_restaurant_performance(
        marts.fct_orders(staging.stg_orders(o)), dim).collect()}
    assert out[7].city == "Dim City" and out[7].orders == 2 and out[7].revenue == Decimal("10.00")
    assert out[7].avg_customer_rating == 3.5 and out[7].avg_delivery_min == 15.0
    assert out[None].restaurant_name is None and out[None].orders == 1


def test_dim_date_fixed_spine(spark):
    d = marts.dim_date(spark)
    assert d.count() == 1096
    first = d.orderBy("date_day").first()
    assert (first.date_day, first.month_name, first.day_name, first.is_weekend) == \
        (dt.date(2024, 1, 1), "Jan", "Mon", False)
    assert d.where(F.col("date_day") == dt.date(2024, 1, 6)).first().is_weekend is True
    assert d.agg(F.max("date_day")).first()[0] == dt.date(2026, 12, 31)


def test_fct_order_items_inner_join(spark):
    t = dt.datetime(2024, 1, 1, 9)
    o = _orders(spark, [(1, t, "Pune", "Delivered", "10.00", 10, 7, 4)])
    items = raw(spark, "order_items", [("a", 1, 7, "f", 1.005, 2.5, 3.0), ("b", 2, 7, "f", 1.0, 1.0, 1.0)])
    out = marts.fct_order_items(staging.stg_order_items(items), staging.stg_orders(o)).collect()
    assert [(r.order_item_id, r.city, r.quantity) for r in out] == [("a", "Pune", 3)]


def test_delivery_sla_approx_option(spark):
    t = dt.datetime(2024, 1, 1, 9)
    o = _orders(spark, [(i, t, "Pune", "Delivered", "1.00", m, 1, 1) for i, m in enumerate([10, 20, 30, 40, 50])])
    r = marts.mart_delivery_sla(marts.fct_orders(staging.stg_orders(o)), approx_accuracy=10000).first()
    assert (r.p50, r.p90) == (30.0, 50.0)      # nearest rank, no interpolation
