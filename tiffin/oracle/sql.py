"""Independent SQL statement of every registered query, for DuckDB.

The driver's tables are pre-registered as views; the adapter and the models are
restated here as CTEs. Only fixed value lists are shared with the Spark side.

Rules that keep the two engines bit-identical:
* decimal outputs are compared as DOUBLE;
* integer outputs are cast to the Spark type (BIGINT / INTEGER);
* ``round`` of a double follows Spark (half-up on the shortest decimal text of
  the value), see ``sround``.
"""

from __future__ import annotations

from ..operators import enrich
from ..sources import fixtures as fx

# --------------------------------------------------------------------- helpers


def q(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def sround(expr: str, digits: int) -> str:
    """Spark's round(double, d): half-up on the value's shortest decimal text."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def pick(index: str, values: list) -> str:
    return "([" + ", ".join(q(v) for v in values) + f"])[({index}) + 1]"


def count_if(cond: str) -> str:
    """Spark / warehouse ``count_if``: 0, never NULL, when no row qualifies."""
    return f"count(CASE WHEN {cond} THEN 1 END)"


def case_map(expr: str, mapping: dict) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + " END"


def try_number(x: str) -> str:
    return f"TRY_CAST(TRY_CAST({x} AS DECIMAL(38,0)) AS BIGINT)"


def after_last_comma(x: str) -> str:
    return f"trim(coalesce(nullif(regexp_extract({x}, '[^,]+$'), ''), {x}))"


def first_number(x: str) -> str:
    return try_number(f"nullif(regexp_extract({x}, '[0-9]+'), '')")


_DELIMS = "' !?@\"^#$&~_,.:;+-*%/|\\[](){}<>' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def initcap(x: str) -> str:
    lx = f"lower({x})"
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE array_to_string(list_transform(range(1, length({lx}) + 1), "
            f"lambda i: CASE WHEN i = 1 OR strpos({_DELIMS}, substr({lx}, i - 1, 1)) > 0 "
            f"THEN upper(substr({lx}, i, 1)) ELSE substr({lx}, i, 1) END), '') END")


def messy_city(k: str, name: str) -> str:
    return (f"CASE WHEN {k} % 43 = 0 THEN NULL WHEN {k} % 5 = 1 THEN {name} || ',' "
            f"WHEN {k} % 5 = 2 THEN 'Area 1, Zone ,  ' || {name} "
            f"WHEN {k} % 5 = 3 THEN 'Sector ' || CAST({k} % 7 AS VARCHAR) || ', ' || {name} ELSE {name} END")


def contains_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def count_contained(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {q(w)}) AS INTEGER)" for w in words) + ")"


def sentiment(text: str) -> str:
    t = f"lower({text})"
    pos, neg = count_contained(t, enrich.POSITIVE_WORDS), count_contained(t, enrich.NEGATIVE_WORDS)
    return f"CASE WHEN {pos} > {neg} THEN 'positive' WHEN {neg} > {pos} THEN 'negative' ELSE 'neutral' END"


def category(text: str) -> str:
    t = f"lower({text})"
    return ("CASE " + " ".join(f"WHEN {contains_any(t, words)} THEN {q(name)}"
                               for name, words in enrich.CATEGORY_RULES) + " ELSE 'other' END")


def sentiment_score(text: str) -> str:
    t = f"lower({text})"
    pos, neg = count_contained(t, enrich.POSITIVE_WORDS), count_contained(t, enrich.NEGATIVE_WORDS)
    return f"CAST({pos} - {neg} AS DOUBLE) / greatest({pos} + {neg}, 1)"


def key_issue(text: str) -> str:
    t = f"lower({text})"
    return "CASE " + " ".join(f"WHEN contains({t}, {q(w)}) THEN {q(w)}" for w in enrich.NEGATIVE_WORDS) + " END"


def confidence(key: str) -> str:
    return f"(80 + (({key}) * 7 + 3) % 19) / 100.0"


# --------------------------------------------------------------------- adapter
_LINES = """SELECT l_orderkey, min(l_suppkey) AS r_id, count(*) AS items_count, sum(l_quantity) AS sales_qty,
  sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS subtotal,
  sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS discount,
  sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS gst
FROM lineitem GROUP BY l_orderkey"""

_K = "o.o_orderkey"
_STATUS = case_map("o.o_orderstatus", fx.STATUS_BY_CODE)

RAW_CTES = {
    "raw_orders": f"""SELECT {_K} AS order_id,
  o.o_orderdate + to_hours(CAST({_K} % 24 AS BIGINT)) AS order_timestamp,
  CAST(o.o_orderdate AS DATE) AS order_date,
  o.o_custkey AS user_id, li.r_id AS r_id,
  {messy_city(_K, 'n.n_name')} AS restaurant_city,
  CASE WHEN {_K} % 23 = 0 THEN NULL ELSE c.c_mktsegment END AS cuisine,
  CAST(coalesce(li.items_count, 0) AS BIGINT) AS items_count,
  coalesce(li.sales_qty, 0.0) AS sales_qty,
  CAST(li.subtotal AS DECIMAL(12,2)) AS subtotal,
  CAST(li.discount AS DECIMAL(12,2)) AS discount,
  CAST({_K} % 50 AS DECIMAL(12,2)) AS delivery_fee,
  CAST(li.gst AS DECIMAL(12,2)) AS gst,
  CASE WHEN {_K} % 41 = 0 THEN NULL ELSE CAST(o.o_totalprice AS DECIMAL(12,2)) END AS sales_amount,
  'INR' AS currency,
  {case_map('o.o_orderpriority', fx.PAYMENT_BY_PRIORITY)} AS payment_method,
  CASE WHEN {_K} % 59 = 0 THEN NULL WHEN {_K} % 53 = 0 THEN 'Pending' ELSE {_STATUS} END AS order_status,
  CAST(CASE WHEN {_K} % 7 = 0 THEN NULL ELSE 1 + {_K} % 5 END AS BIGINT) AS customer_rating,
  CAST(CASE WHEN {_K} % 11 = 0 THEN NULL ELSE 15 + ({_K} * 37) % 61 END AS BIGINT) AS delivery_time_min
FROM orders o
LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN ({_LINES}) li ON {_K} = li.l_orderkey""",
    "raw_order_items": """SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
    CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y%m%d')) AS order_item_id,
  l_orderkey AS order_id, l_suppkey AS r_id, 'fd' || CAST(l_partkey AS VARCHAR) AS f_id,
  p.p_retailprice AS price, l_quantity AS quantity, l_extendedprice AS line_amount
FROM lineitem LEFT JOIN part p ON l_partkey = p.p_partkey""",
    "raw_restaurants": f"""SELECT
  CASE WHEN s_suppkey % 17 = 0 THEN 'N/A' ELSE CAST(s_suppkey AS VARCHAR) END AS id,
  s_name AS name,
  {messy_city('s_suppkey', 'n_name')} AS city,
  CASE WHEN s_suppkey % 6 = 0 THEN '--'
       WHEN s_suppkey % 6 = 1 THEN CAST(1 + s_suppkey % 4 AS VARCHAR) || '.' || CAST(s_suppkey % 10 AS VARCHAR) || '5'
       ELSE CAST(1 + s_suppkey % 4 AS VARCHAR) || '.' || CAST(s_suppkey % 10 AS VARCHAR) END AS rating,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Too Few Ratings' ELSE CAST(s_suppkey % 500 AS VARCHAR) || '+ ratings' END
    AS rating_count,
  CASE WHEN s_suppkey % 9 = 0 THEN '₹ 1,200' ELSE '₹ ' || CAST(100 + 50 * (s_suppkey % 20) AS VARCHAR) END AS cost,
  {pick('s_suppkey % 5', fx.CUISINES)} AS cuisine,
  'LIC' || lpad(CAST((s_suppkey * 7919) % 100000 AS VARCHAR), 5, '0') AS lic_no
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
    "raw_users": f"""SELECT
  CASE WHEN c_custkey % 31 = 0 THEN 'u' || CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS user_id,
  c_name AS name, c_name || '@Mail.Example' AS email,
  CASE WHEN c_custkey % 13 = 0 THEN 'unknown' WHEN c_custkey % 13 = 1 THEN NULL
       ELSE CAST(18 + (c_custkey * 7) % 60 AS VARCHAR) END AS age,
  CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
  {pick('c_custkey % 3', fx.MARITAL)} AS marital_status,
  {pick('c_custkey % 4', fx.OCCUPATIONS)} AS occupation,
  {pick('c_custkey % 5', fx.INCOME_BANDS)} AS monthly_income,
  {pick('(c_custkey * 3 + 1) % 5', fx.EDUCATION)} AS education,
  CASE WHEN c_custkey % 10 = 0 THEN '' ELSE CAST(1 + c_custkey % 6 AS VARCHAR) END AS family_size
FROM customer""",
    "raw_food": f"""SELECT CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE 'fd' || CAST(p_partkey AS VARCHAR) END AS f_id,
  p_name AS item, {pick('p_partkey % 5', fx.VEG_LABELS)} AS veg_or_non_veg
FROM part""",
    "raw_menu": f"""SELECT 'm' || CAST(p_partkey AS VARCHAR) AS menu_id,
  CASE WHEN p_partkey % 13 = 0 THEN 'abc' ELSE CAST(p_partkey % 97 AS VARCHAR) END AS r_id,
  'fd' || CAST(p_partkey AS VARCHAR) AS f_id,
  {pick('p_partkey % 5', fx.CUISINES)} AS cuisine,
  CASE p_partkey % 11 WHEN 0 THEN 'free' WHEN 1 THEN '0' WHEN 2 THEN '-5' WHEN 3 THEN NULL
       ELSE CAST(100 + (p_partkey * 13) % 900 AS VARCHAR) || '.50' END AS price
FROM part""",
    "raw_reviews": f"""SELECT order_id AS review_id, order_id, user_id, CAST(r_id AS VARCHAR) AS restaurant_id,
  CASE WHEN order_id % 37 = 0 THEN NULL ELSE CAST(1 + (order_id * 7) % 5 AS BIGINT) END AS rating,
  CASE WHEN order_id % 29 = 0 THEN NULL ELSE {pick(f'order_id % {len(fx.REVIEW_PHRASES)}', fx.REVIEW_PHRASES)}
    || {pick(f'(order_id // 3) % {len(fx.REVIEW_ENDINGS)}', fx.REVIEW_ENDINGS)} END AS comment,
  CASE WHEN order_id % 31 = 0 THEN NULL ELSE order_date END AS review_date
FROM raw_orders""",
}

# --------------------------------------------------------------------- models
MODEL_CTES = {
    "stg_restaurants": f"""SELECT {try_number('id')} AS restaurant_id, name AS restaurant_name,
  {after_last_comma('city')} AS city,
  TRY_CAST(nullif(rating, '--') AS DECIMAL(3,1)) AS rating,
  {first_number('rating_count')} AS rating_count,
  {first_number('cost')} AS cost_for_two,
  cuisine, lic_no AS license_no
FROM raw_restaurants WHERE {try_number('id')} IS NOT NULL""",
    "stg_users": f"""SELECT {try_number('user_id')} AS customer_id, name AS customer_name, lower(email) AS email,
  {try_number('age')} AS age, gender, marital_status, occupation, monthly_income AS income_band, education,
  {try_number('family_size')} AS family_size
FROM raw_users WHERE {try_number('user_id')} IS NOT NULL""",
    "stg_food": f"""SELECT f_id, item AS food_name, {initcap('veg_or_non_veg')} AS veg_or_non_veg
FROM raw_food WHERE f_id IS NOT NULL""",
    "stg_menu": f"""SELECT menu_id, {try_number('r_id')} AS restaurant_id, f_id, cuisine,
  TRY_CAST(price AS DECIMAL(10,2)) AS price
FROM raw_menu WHERE {try_number('r_id')} IS NOT NULL AND TRY_CAST(price AS DECIMAL(10,2)) > 0""",
    "stg_orders": f"""SELECT order_id, order_timestamp, order_date, user_id AS customer_id, r_id AS restaurant_id,
  {after_last_comma('restaurant_city')} AS city, cuisine, items_count, sales_qty, subtotal, discount,
  delivery_fee, gst, sales_amount, currency, payment_method, order_status,
  (order_status = 'Delivered') AS is_delivered, customer_rating, delivery_time_min
FROM raw_orders""",
    "stg_order_items": """SELECT order_item_id, order_id, r_id AS restaurant_id, f_id,
  CAST(price AS DECIMAL(10,2)) AS price, CAST(CAST(quantity AS DECIMAL(38,0)) AS BIGINT) AS quantity,
  CAST(line_amount AS DECIMAL(10,2)) AS line_amount
FROM raw_order_items""",
    "stg_reviews": f"""SELECT r.review_id, r.order_id, CAST(r.user_id AS BIGINT) AS customer_id,
  CAST(r.restaurant_id AS VARCHAR) AS restaurant_id, CAST(r.rating AS BIGINT) AS rating,
  CAST(r.comment AS VARCHAR) AS comment, CAST(r.review_date AS DATE) AS review_date, res.city AS city
FROM raw_reviews r LEFT JOIN stg_restaurants res ON {try_number('r.restaurant_id')} = res.restaurant_id
WHERE r.comment IS NOT NULL""",
    "dim_customers": """SELECT customer_id, customer_name, email, age,
  CASE WHEN age < 25 THEN 'Gen Z' WHEN age < 40 THEN 'Millennial' WHEN age < 55 THEN 'Gen X'
       WHEN age IS NULL THEN 'Unknown' ELSE 'Boomer' END AS age_segment,
  gender, marital_status, occupation, income_band, education, family_size
FROM stg_users""",
    "dim_restaurants": """SELECT restaurant_id, restaurant_name, city, cuisine, rating, rating_count, cost_for_two
FROM stg_restaurants""",
    "dim_food": "SELECT f_id, food_name, veg_or_non_veg FROM stg_food",
    "fct_orders": """SELECT order_id, order_timestamp, order_date, customer_id, restaurant_id, city, cuisine,
  payment_method, order_status, is_delivered, items_count, sales_qty, subtotal, discount, delivery_fee, gst,
  sales_amount, customer_rating, delivery_time_min
FROM stg_orders""",
    "fct_order_items": """SELECT oi.order_item_id, oi.order_id, oi.restaurant_id, oi.f_id, o.order_timestamp AS order_ts,
  o.order_date, o.city, oi.price, oi.quantity, oi.line_amount
FROM stg_order_items oi JOIN stg_orders o USING (order_id)""",
    "mart_daily_city_revenue": f"""SELECT order_date, city, count(*) AS orders,
  count(CASE WHEN is_delivered THEN 1 END) AS delivered_orders,
  {sround("CASE WHEN count(*) = 0 THEN 0 ELSE count(CASE WHEN order_status = 'Cancelled' THEN 1 END) / count(*) END", 4)}
    AS cancel_rate,
  sum(CASE WHEN is_delivered THEN sales_amount ELSE 0 END) AS gmv,
  CASE WHEN count(CASE WHEN is_delivered THEN 1 END) = 0 THEN 0.0
       ELSE CAST((2 * CAST(sum(CASE WHEN is_delivered THEN sales_amount ELSE 0 END) * 100 AS HUGEINT)
                  + count(CASE WHEN is_delivered THEN 1 END)) // (2 * count(CASE WHEN is_delivered THEN 1 END)) AS DOUBLE) / 100 END AS aov
FROM fct_orders GROUP BY 1, 2""",
    "mart_delivery_sla": f"""SELECT city, CAST(hour(order_timestamp) AS INTEGER) AS order_hour,
  count(CASE WHEN is_delivered THEN 1 END) AS delivered_orders,
  {sround('median(delivery_time_min)', 1)} AS p50,
  {sround('quantile_cont(delivery_time_min, 0.9)', 1)} AS p90
FROM fct_orders WHERE is_delivered GROUP BY 1, 2""",
    "mart_delivery_value": f"""SELECT city, CAST(hour(order_timestamp) AS INTEGER) AS order_hour, count(*) AS delivered_orders,
  {sround('quantile_cont(CAST(sales_amount AS DOUBLE) / delivery_time_min, 0.5)', 6)} AS p50,
  {sround('quantile_cont(CAST(sales_amount AS DOUBLE) / delivery_time_min, 0.9)', 6)} AS p90
FROM fct_orders WHERE is_delivered GROUP BY 1, 2""",
    "mart_restaurant_performance": f"""SELECT f.restaurant_id, r.restaurant_name, r.city, r.cuisine,
  count(*) AS orders,
  sum(CASE WHEN f.is_delivered THEN f.sales_amount ELSE 0 END) AS revenue,
  {sround('avg(f.customer_rating)', 2)} AS avg_customer_rating,
  {sround('avg(f.delivery_time_min)', 1)} AS avg_delivery_min
FROM fct_orders f LEFT JOIN dim_restaurants r USING (restaurant_id)
GROUP BY 1, 2, 3, 4""",
    "review_enriched": f"""SELECT CAST(review_id AS VARCHAR) AS review_id, {sentiment('comment')} AS sentiment_label,
  {sentiment_score('comment')} AS sentiment_score,
  CASE {category('comment')} {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in enrich.TOPIC_BY_CATEGORY.items())} END
    AS topic,
  {key_issue('comment')} AS key_issue, {q(enrich.KEYWORD_MODEL)} AS model
FROM raw_reviews WHERE comment IS NOT NULL""",
    "mart_review_insights": f"""SELECT rr.city, e.topic, e.sentiment_label, count(*) AS reviews,
  {sround('avg(e.sentiment_score)', 3)} AS avg_sentiment_score,
  {sround('avg(rr.rating)', 2)} AS avg_star_rating,
  count(e.key_issue) AS flagged_issues
FROM review_enriched e JOIN stg_reviews rr ON {try_number('e.review_id')} = rr.review_id
GROUP BY 1, 2, 3""",
}


def with_ctes(select: str) -> str:
    ctes = {**RAW_CTES, **MODEL_CTES}
    body = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in ctes.items())
    return f"WITH {body}\n{select}"


def as_double(cols: list[str]) -> str:
    """``* REPLACE`` list turning decimal columns into DOUBLE."""
    return "* REPLACE (" + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols) + ")"


CALENDAR_SQL = """SELECT d AS date_day, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
  strftime(d, '%b') AS month_name, strftime(d, '%a') AS day_name, isodow(d) >= 6 AS is_weekend
FROM (SELECT CAST(unnest(generate_series(min(order_date), max(order_date), INTERVAL 1 DAY)) AS DATE) AS d
      FROM fct_orders) s"""


def _dq(name, model, column, kind, failing_sql):
    return (f"SELECT {q(name)} AS test_name, {q(model)} AS model, {q(column)} AS column_name, {q(kind)} AS test_kind, "
            f"count(*) AS failures FROM ({failing_sql}) t")


def _unique(model, col):
    return (f"unique_{model}_{col}", model, col, "unique",
            f"SELECT {col} FROM {model} WHERE {col} IS NOT NULL GROUP BY {col} HAVING count(*) > 1")


def _not_null(model, col):
    return (f"not_null_{model}_{col}", model, col, "not_null", f"SELECT * FROM {model} WHERE {col} IS NULL")


DQ_REPORT_SQL = "\nUNION ALL\n".join(_dq(*t) for t in [
    _unique("stg_orders", "order_id"), _not_null("stg_orders", "order_id"),
    _not_null("stg_orders", "customer_id"), _not_null("stg_orders", "restaurant_id"),
    _unique("stg_order_items", "order_item_id"), _not_null("stg_order_items", "order_item_id"),
    _unique("stg_users", "customer_id"), _not_null("stg_users", "customer_id"),
    _unique("fct_orders", "order_id"), _not_null("fct_orders", "order_id"),
    ("relationships_fct_orders_customer_id", "fct_orders", "customer_id", "relationships",
     "SELECT f.customer_id FROM fct_orders f WHERE f.customer_id IS NOT NULL AND NOT EXISTS "
     "(SELECT 1 FROM dim_customers d WHERE d.customer_id = f.customer_id)"),
    ("accepted_values_fct_orders_order_status", "fct_orders", "order_status", "accepted_values",
     "SELECT order_status FROM fct_orders WHERE order_status IS NOT NULL AND "
     "order_status NOT IN ('Delivered', 'Cancelled', 'Refunded') GROUP BY order_status"),
])


# --------------------------------------------------------------------- enrichment / catalogue / retrieval
from ..operators import catalogue as cat  # noqa: E402
from ..operators import retrieval as rt  # noqa: E402

ENRICH_CUTOFF = "1998-06-01"


def topic_of(text: str) -> str:
    return ("CASE " + category(text) + " " +
            " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in enrich.TOPIC_BY_CATEGORY.items()) + " END")


WS = r"[\s\x{0b}\p{Z}\x{1c}-\x{1f}\x{85}]"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def route(text: str, plural_aware: bool = False) -> str:
    qq = strip_ws(f"lower({text})")

    def has(w):
        if plural_aware and w == "city":
            return f"(contains({qq}, 'city') OR contains({qq}, 'cities'))"
        return f"contains({qq}, {q(w)})"
    parts = []
    for tid, rule in cat.ROUTES:
        conds = []
        if "all_of" in rule:
            conds.append("(" + " AND ".join(has(w) for w in rule["all_of"]) + ")")
        conds += [has(w) for w in rule.get("any_of", [])]
        conds += [f"{qq} = {q(w)}" for w in rule.get("equals", [])]
        parts.append(f"WHEN {' OR '.join(conds)} THEN {q(tid)}")
    return "CASE " + " ".join(parts) + " END"


def keyed_texts(texts: list[str]) -> str:
    """Conversations with their own texts, and with a text of the list by key (DuckDB lists count from 1)."""
    literals = ", ".join(q(t) for t in texts)
    return (f"(SELECT conv_id, turn, role, 'given' AS origin, text FROM conversations UNION ALL SELECT conv_id, turn, role, 'keyed', "
            f"[{literals}][CAST(1 + (conv_id * 7 + turn) % {len(texts)} AS INTEGER)] FROM conversations)")


#: The statement words a text may not hold as a word of their own, stated apart from the code under test.
_FORBIDDEN = r"(?:^|[^\p{L}\p{N}_])(?:drop|delete|truncate|alter|update|insert|create|replace|grant|revoke)(?:[^\p{L}\p{N}_]|$)"


def is_safe(text: str) -> str:
    low = strip_ws(f"lower({text})")
    body = f"regexp_replace({low}, '--[^\\n]*', '', 'g')"
    pat = _FORBIDDEN
    return (f"coalesce({text} IS NOT NULL AND {text} <> '' AND (starts_with({low}, 'select') OR "
            f"starts_with({low}, 'with')) AND NOT regexp_matches({body}, '{pat}') AND NOT contains({body}, ';'), "
            f"false)")


def is_safe_v1(text: str) -> str:
    low = f"lower({text})"
    bad = " OR ".join(f"contains({low}, {q(w)})" for w in cat.FORBIDDEN_WORDS)
    return f"coalesce((starts_with({low}, 'select') OR starts_with({low}, 'with')) AND NOT ({bad}), false)"


def normalize_sql(text: str, prefixes=("TIFFIN.MARTS.", "TIFFIN.")) -> str:
    x = text
    for p in prefixes:
        x = f"replace({x}, {q(p)}, '')"
    return f"regexp_replace({strip_ws(x)}, ';+$', '')"


def keyword_vector(text: str) -> str:
    t = f"lower({text})"
    return "[" + ", ".join(f"CAST(contains({t}, {q(w)}) AS DOUBLE)" for w in rt.EMBED_KEYWORDS) + "]"


def dot(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]), lambda x, y: x + y)"


def cosine(a: str, b: str) -> str:
    den = f"(sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"
    return f"CASE WHEN {den} = 0 THEN 0.0 ELSE {dot(a, b)} / {den} END"


def questions_values() -> str:
    rows = ", ".join(f"({i + 1}, {q(t)})" for i, t in enumerate(rt.EXAMPLE_QUESTIONS))
    return f"SELECT * FROM (VALUES {rows}) t(question_id, question)"


RETRIEVAL_CTES = f"""qs AS ({questions_values()}),
qv AS (SELECT CAST(question_id AS INTEGER) AS question_id, question, {keyword_vector('question')} AS v FROM qs),
rv AS (SELECT review_id, city, rating, CAST(comment AS VARCHAR) AS comment, {keyword_vector('comment')} AS e
       FROM stg_reviews WHERE comment IS NOT NULL),
sc AS (SELECT qv.question_id AS query_id, rv.*, {cosine('qv.v', 'rv.e')} AS score FROM qv CROSS JOIN rv),
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, review_id)
        AS INTEGER) AS rank FROM sc) WHERE rank <= {rt.TOP_K})"""


def _with_extra(extra: str, select: str) -> str:
    ctes = {**RAW_CTES, **MODEL_CTES}
    body = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in ctes.items())
    return f"WITH {body},\n{extra}\n{select}"


def with_retrieval(select: str) -> str:
    return _with_extra(RETRIEVAL_CTES, select)


def answer_sql() -> str:
    lq = "lower(qv.question)"
    delivery = (f"CASE WHEN a.n_delivery > 0 THEN 'Based on the ' || CAST(a.n_delivery AS VARCHAR) || "
                f"' most relevant reviews, delivery is mainly discussed in terms of timeliness and speed.' "
                f"ELSE {q(rt.TEXT_NO_DELIVERY)} END")
    rating = (f"'The average rating among the ' || CAST(coalesce(a.n_top, 0) AS VARCHAR) || ' most relevant reviews is ' "
              f"|| coalesce(CAST({sround('a.avg_rating', 2)} AS VARCHAR), 'None') || ' stars.'")
    default = (f"'I found ' || CAST(coalesce(a.n_top, 0) AS VARCHAR) || ' relevant reviews, but the mock AI cannot "
               f"provide a detailed answer to this question yet.'")
    return (f"CASE WHEN {contains_any(lq, rt.ANSWER_DELIVERY_QUESTION)} THEN {delivery} "
            f"WHEN {contains_any(lq, rt.ANSWER_FOOD)} THEN {q(rt.TEXT_FOOD)} "
            f"WHEN {contains_any(lq, rt.ANSWER_PACKAGING)} THEN {q(rt.TEXT_PACKAGING)} "
            f"WHEN {contains_any(lq, rt.ANSWER_SERVICE)} THEN {q(rt.TEXT_SERVICE)} "
            f"WHEN {contains_any(lq, rt.ANSWER_PRICE)} THEN {q(rt.TEXT_PRICE)} "
            f"WHEN {contains_any(lq, rt.ANSWER_RATING)} THEN {rating} ELSE {default} END")


EMBED_CTES = f"""cdim AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m
  FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
cv AS (SELECT label AS query_id, list(m ORDER BY i) AS v FROM cdim GROUP BY label),
ev AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
esc AS (SELECT cv.query_id, ev.vec_id, ev.label, round({cosine('cv.v', 'ev.e')}, 6) AS score FROM cv CROSS JOIN ev)"""


def _half_up_ratio(num_cents: str, den: str, scale: int = 100) -> str:
    """round(num / den, 2) for non-negative exact values, as integer half-up (DOUBLE)."""
    return (f"CASE WHEN ({den}) = 0 THEN NULL ELSE CAST((2 * CAST({num_cents} AS HUGEINT) + ({den})) // "
            f"(2 * ({den})) AS DOUBLE) / {scale} END")


CATALOGUE_ORACLE = {
    "city_gmv": """SELECT city, CAST(SUM(gmv) AS DOUBLE) AS gmv FROM mart_daily_city_revenue GROUP BY city
ORDER BY SUM(gmv) DESC NULLS FIRST, city ASC NULLS LAST LIMIT 10""",
    "cuisine_orders": """SELECT cuisine, COUNT(*) AS orders FROM fct_orders GROUP BY cuisine
ORDER BY orders DESC, cuisine ASC NULLS LAST LIMIT 10""",
    "delivery_by_city": f"""SELECT city, {sround('AVG(delivery_time_min)', 2)} AS avg_delivery_time_min FROM fct_orders
WHERE is_delivered = TRUE GROUP BY city ORDER BY 2 DESC NULLS FIRST, city ASC NULLS LAST LIMIT 100""",
    "cancel_by_payment": f"""SELECT payment_method,
{_half_up_ratio("10000 * SUM(CASE WHEN lower(order_status) = 'cancelled' THEN 1 ELSE 0 END)", "COUNT(*)")} AS cancel_rate
FROM fct_orders GROUP BY payment_method ORDER BY 2 DESC NULLS FIRST, payment_method ASC NULLS LAST LIMIT 100""",
    "restaurant_revenue": """SELECT restaurant_name, city, CAST(revenue AS DOUBLE) AS revenue
FROM mart_restaurant_performance ORDER BY mart_restaurant_performance.revenue DESC NULLS FIRST,
restaurant_id ASC NULLS LAST LIMIT 10""",
    "aov": f"""SELECT {_half_up_ratio("SUM(gmv) * 100", "SUM(orders)")} AS average_order_value
FROM mart_daily_city_revenue""",
    "cancel_city": """SELECT city, cancel_rate FROM mart_daily_city_revenue GROUP BY city, cancel_rate
ORDER BY cancel_rate DESC NULLS FIRST, city ASC NULLS LAST LIMIT 10""",
    "orders_by_payment": """SELECT payment_method, COUNT(*) AS orders FROM fct_orders GROUP BY payment_method
ORDER BY orders DESC, payment_method ASC NULLS LAST LIMIT 100""",
    "avg_delivery": f"""SELECT {sround('AVG(delivery_time_min)', 2)} AS average_delivery_time_min FROM fct_orders
WHERE is_delivered = TRUE""",
    "cuisine_revenue": """SELECT cuisine, CAST(SUM(sales_amount) AS DOUBLE) AS revenue FROM fct_orders GROUP BY cuisine
ORDER BY SUM(sales_amount) DESC NULLS FIRST, cuisine ASC NULLS LAST LIMIT 10""",
    "orders_by_city": """SELECT city, COUNT(*) AS orders FROM fct_orders GROUP BY city
ORDER BY orders DESC, city ASC NULLS LAST LIMIT 100""",
    "total_orders": "SELECT COUNT(*) AS total_orders FROM fct_orders",
    "cancel_city_overall": f"""SELECT city,
{sround("SUM(CASE WHEN order_status = 'Cancelled' THEN 1 ELSE 0 END) / COUNT(*)", 4)} AS cancel_rate
FROM fct_orders GROUP BY city ORDER BY 2 DESC NULLS FIRST, city ASC NULLS LAST LIMIT 10""",
}
