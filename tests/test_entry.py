import importlib

ROWS_ONLY: set[str] = set()


def test_entry_smoke(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.columns == ["order_date", "city", "orders", "delivered_orders", "cancel_rate", "gmv", "aov"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    entry = importlib.import_module("__spark_entry__")
    from tiffin.registry import QUERIES
    o = entry.oracle_sql()
    assert set(o) <= set(entry.queries())
    q, o = QUERIES, {k: v for k, v in o.items() if k in QUERIES}
    assert set(q) - set(o) == ROWS_ONLY
    assert len(q) >= 70
