"""Declarative data-quality tests (Q1-Q5).

Each test returns its failing rows as a DataFrame; ``dq_report`` counts them in
one job (one row per test) and ``gate`` raises before anything downstream is
published, like a failing test in a build.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_failures(df: DataFrame, column: str) -> DataFrame:
    """Q1: non-null values occurring more than once (one row per value)."""
    return (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_records"))
            .where(F.col("n_records") > 1))


def not_null_failures(df: DataFrame, column: str) -> DataFrame:
    """Q2: rows where the column is NULL."""
    return df.where(F.col(column).isNull())


def relationship_failures(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Q3: non-null child keys without a parent row (anti join)."""
    keys = parent.select(F.col(field).alias("_parent_key")).where(F.col("_parent_key").isNotNull())
    c = child.where(F.col(column).isNotNull()).select(F.col(column).alias("_child_key"))
    return c.join(keys, c["_child_key"] == keys["_parent_key"], "left_anti").withColumnRenamed("_child_key", column)


def relationship_failure_count(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Q3 as a count of failing rows, pre-aggregated: child rows are counted per key
    (partial aggregation before the shuffle), so the anti join sees one row per
    distinct key, and a key holding a third of all rows costs one row."""
    keys = parent.select(F.col(field).alias("_parent_key")).where(F.col("_parent_key").isNotNull())
    per_key = (child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_child_key"))
               .agg(F.count(F.lit(1)).alias("_n")))
    orphans = per_key.join(keys, per_key["_child_key"] == keys["_parent_key"], "left_anti")
    return orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("failures"))


def accepted_values_failures(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Q4: values outside the accepted list (NULL passes), one row per value."""
    return (df.where(F.col(column).isNotNull() & ~F.col(column).isin(values))
            .groupBy(column).agg(F.count(F.lit(1)).alias("n_records")))


@dataclass(frozen=True)
class Test:
    name: str
    model: str
    column: str
    kind: str
    args: tuple = ()


# The project's declared tests. The relationships test points at the customer
# dimension by its real name.
PROJECT_TESTS = [
    Test("unique_stg_orders_order_id", "stg_orders", "order_id", "unique"),
    Test("not_null_stg_orders_order_id", "stg_orders", "order_id", "not_null"),
    Test("not_null_stg_orders_customer_id", "stg_orders", "customer_id", "not_null"),
    Test("not_null_stg_orders_restaurant_id", "stg_orders", "restaurant_id", "not_null"),
    Test("unique_stg_order_items_order_item_id", "stg_order_items", "order_item_id", "unique"),
    Test("not_null_stg_order_items_order_item_id", "stg_order_items", "order_item_id", "not_null"),
    Test("unique_stg_users_customer_id", "stg_users", "customer_id", "unique"),
    Test("not_null_stg_users_customer_id", "stg_users", "customer_id", "not_null"),
    Test("unique_fct_orders_order_id", "fct_orders", "order_id", "unique"),
    Test("not_null_fct_orders_order_id", "fct_orders", "order_id", "not_null"),
    Test("relationships_fct_orders_customer_id", "fct_orders", "customer_id", "relationships",
         ("dim_customers", "customer_id")),
    Test("accepted_values_fct_orders_order_status", "fct_orders", "order_status", "accepted_values",
         ("Delivered", "Cancelled", "Refunded")),
]


def failures(test: Test, models) -> DataFrame:
    df = models.table(test.model)
    if test.kind == "unique":
        return unique_failures(df, test.column)
    if test.kind == "not_null":
        return not_null_failures(df, test.column)
    if test.kind == "relationships":
        parent, field = test.args
        return relationship_failures(df, test.column, models.table(parent), field)
    if test.kind == "accepted_values":
        return accepted_values_failures(df, test.column, list(test.args))
    raise ValueError(test.kind)


def dq_report(models, tests: list[Test] = PROJECT_TESTS) -> DataFrame:
    """Q5: one row per test with its number of failing rows.

    A model is read once for its unique column and all its not_null tests (one row
    per key after partial aggregation, then one row in all) and once more if it has
    accepted_values or relationships tests: their columns are grouped together, so
    both work on one row per distinct pair, and a customer holding a third of all
    orders reaches the anti join as a few rows.
    """
    parts: list[DataFrame] = []

    def stacked(counts: DataFrame, names: list[str]) -> None:
        stack = ", ".join(f"'{n}', `{n}`" for n in names)
        parts.append(counts.selectExpr(f"stack({len(names)}, {stack}) AS (test_name, failures)"))

    by_model: dict[str, list[Test]] = {}
    for t in tests:
        by_model.setdefault(t.model, []).append(t)
    for model, ts in by_model.items():
        df = models.table(model)
        unique = [t for t in ts if t.kind == "unique"]
        null = [t for t in ts if t.kind == "not_null"]
        keys = list(dict.fromkeys(t.column for t in unique))
        if keys or null:
            # The not_null counts ride along with the first unique column, or form a plain scan.
            for i, key in enumerate(keys or [None]):
                ride = null if i == 0 else []
                counts = [F.count_if(F.col(t.column).isNull()).alias(t.name) for t in ride]
                if key is None:
                    stacked(df.agg(*counts), [t.name for t in ride])
                    continue
                per_key = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), *counts)
                mine = [t.name for t in unique if t.column == key]
                repeated = F.count_if(F.col("_key").isNotNull() & (F.col("_n") > 1))
                stacked(per_key.agg(*[repeated.alias(n) for n in mine],
                                    *[F.coalesce(F.sum(t.name), F.lit(0)).alias(t.name) for t in ride]), mine + [t.name for t in ride])
        values = [t for t in ts if t.kind == "accepted_values"]
        links = [t for t in ts if t.kind == "relationships"]
        columns = list(dict.fromkeys(t.column for t in values + links))
        if columns:
            groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
            if values:   # one failing row per distinct unaccepted value
                stacked(groups.agg(*[F.count_distinct(F.when(F.col(t.column).isNotNull() & ~F.col(t.column).isin(list(t.args)), F.col(t.column)))
                                     .alias(t.name) for t in values]), [t.name for t in values])
            for t in links:
                parent, field = t.args
                keys_ = models.table(parent).select(F.col(field).alias("_parent_key")).where(F.col("_parent_key").isNotNull())
                child = groups.where(F.col(t.column).isNotNull())
                orphans = child.join(keys_, child[t.column] == keys_["_parent_key"], "left_anti")
                parts.append(orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("failures")).select(F.lit(t.name).alias("test_name"), "failures"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    meta = models.table(tests[0].model).sparkSession.createDataFrame(
        [(t.name, t.model, t.column, t.kind) for t in tests], "test_name string, model string, column_name string, "
                                                              "test_kind string")
    return meta.join(out, "test_name", "left").select("test_name", "model", "column_name", "test_kind",
                                                      F.col("failures").cast("bigint").alias("failures"))


class DataQualityError(RuntimeError):
    pass


def gate(models, tests: list[Test] = PROJECT_TESTS, severity_error: bool = True) -> DataFrame:
    """Run the tests; raise when any fails (the build stops before downstream models)."""
    report = dq_report(models, tests).cache()
    failed = report.where(F.col("failures") > 0).collect()  # at most one row per test
    if failed and severity_error:
        msg = ", ".join(f"{r.test_name}={r.failures}" for r in failed)
        report.unpersist()
        raise DataQualityError(f"data tests failed: {msg}")
    return report
