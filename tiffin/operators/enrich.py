"""Review enrichment.

The default classifier is the keyword model, written as Column expressions so a
whole review table is classified inside one codegen stage. A caller-supplied
batch model runs through ``mapInPandas`` (Arrow batches), with failing rows
routed to a rejects output instead of stopping the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import contains_any, count_contained, has_word
from ..functions.matching import WordMatcher

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's keyword classifier.
# A word counts once if it occurs anywhere in the lower-cased text (substring).
# ---------------------------------------------------------------------------
POSITIVE_WORDS = ["great", "good", "excellent", "amazing", "love", "perfect", "fast", "fresh", "delicious",
                  "friendly", "quick", "nice", "happy", "awesome", "on time", "tasty", "wonderful"]
NEGATIVE_WORDS = ["bad", "poor", "terrible", "late", "slow", "cold", "wrong", "awful", "horrible", "dirty",
                  "rude", "missing", "disappointed", "delay", "worst", "unhappy"]
# Category rules, first match wins; no match gives "other".
CATEGORY_RULES = [
    ("delivery", ["delivery", "delivered", "late", "fast", "slow", "on time", "delay"]),
    ("food_quality", ["food", "taste", "delicious", "fresh", "cold", "tasty", "flavor"]),
    ("packaging", ["packaging", "package", "packed", "eco-friendly"]),
    ("service", ["service", "staff", "rude", "friendly", "waiter"]),
    ("price", ["price", "expensive", "cheap", "cost", "value"]),
]
# Topic names of the mart-shaped enrichment table, one per category.
TOPIC_BY_CATEGORY = {"delivery": "Delivery", "food_quality": "Food Quality", "packaging": "Packaging",
                     "service": "Services", "price": "Pricing", "other": "Other"}

KEYWORD_MODEL = "keyword-v2"

REVIEW_COLUMNS = ["review_id", "order_id", "user_id", "restaurant_id", "rating", "comment", "review_date"]


def _lower(text: Column | str) -> Column:
    return F.lower(F.col(text) if isinstance(text, str) else text)


def positive_hits(text: Column | str) -> Column:
    return count_contained(_lower(text), POSITIVE_WORDS)


def negative_hits(text: Column | str) -> Column:
    return count_contained(_lower(text), NEGATIVE_WORDS)


def sentiment(text: Column | str) -> Column:
    """A1: more positive than negative hits -> positive; fewer -> negative; tie -> neutral."""
    pos, neg = positive_hits(text), negative_hits(text)
    return F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")


def category(text: Column | str, whole_words: bool = False) -> Column:
    """A2: ordered rules, first match wins."""
    t = _lower(text)
    out = None
    for name, words in CATEGORY_RULES:
        cond = contains_any(t, words, whole_words)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("other")


def sentiment_score(text: Column | str) -> Column:
    """Score in [-1, 1]: (positive - negative) / max(positive + negative, 1)."""
    pos, neg = positive_hits(text), negative_hits(text)
    return (pos - neg).cast("double") / F.greatest(pos + neg, F.lit(1))


def key_issue(text: Column | str, whole_words: bool = False) -> Column:
    """First negative word (list order) found in the text, else NULL."""
    t = _lower(text)
    out = None
    for w in NEGATIVE_WORDS:
        hit = has_word(t, w, whole_words)
        out = F.when(hit, F.lit(w)) if out is None else out.when(hit, F.lit(w))
    return out


def confidence(key: Column | str) -> Column:
    """Confidence in 0.80 .. 0.98 (steps of 0.01) from the review key.

    The reference draws it at random; a function of the key keeps reruns and
    retried tasks identical.
    """
    k = F.col(key) if isinstance(key, str) else key
    return (F.lit(80) + F.pmod(k.cast("bigint") * 7 + 3, F.lit(19))) / F.lit(100.0)


# ---------------------------------------------------------------- selection
def reviews_to_enrich(reviews: DataFrame, done: DataFrame | None = None, batch_size: int | None = None,
                      oldest_first_then_skip: bool = False, key_filter: bool = False) -> DataFrame:
    """Reviews with a comment that are not enriched yet (J5, set-based anti join).

    ``batch_size`` caps one run to the oldest N (nulls last, ties by id). By default
    the already-enriched rows are removed first, so every run makes progress; with
    ``oldest_first_then_skip`` the cap is applied first, as the reference does, and
    a run can end up with nothing to do. ``key_filter`` tests a Bloom filter of the
    finished keys first, so that only possible repeats are shuffled (same rows).
    """
    from .newkeys import rows_with_new_keys
    from .sampling import first_n
    r = reviews.where(F.col("comment").isNotNull())
    order = [F.col("review_date"), F.col("review_id")]
    if oldest_first_then_skip and batch_size is not None:
        r = first_n(r, batch_size, order)
    if done is not None and key_filter:
        r = rows_with_new_keys(r, done, "review_id")
    elif done is not None:
        r = r.join(done.select("review_id").distinct(), "review_id", "left_anti")
    if batch_size is not None and not oldest_first_then_skip:
        r = first_n(r, batch_size, order)
    return r


# ---------------------------------------------------------------- outputs
def with_keyword_hits(df: DataFrame, text_col: str = "comment", whole_words: bool = False) -> DataFrame:
    """Add ``_lt`` (lower-cased text), ``_pos`` and ``_neg`` (hit counts), computed once per row.

    Later columns read these instead of repeating the keyword tests, which keeps
    the plan small; the optimizer does not inline a non-trivial column that is
    used several times.
    """
    lt = F.lower(F.col(text_col))
    return df.withColumn("_lt", lt).select(
        "*", count_contained(F.col("_lt"), POSITIVE_WORDS, whole_words).alias("_pos"),
        count_contained(F.col("_lt"), NEGATIVE_WORDS, whole_words).alias("_neg"))


def _label(pos: Column, neg: Column) -> Column:
    return F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")


def _score(pos: Column, neg: Column) -> Column:
    return (pos - neg).cast("double") / F.greatest(pos + neg, F.lit(1))


def _topic(cat: Column) -> Column:
    out = None
    for k, v in TOPIC_BY_CATEGORY.items():
        out = F.when(cat == k, v) if out is None else out.when(cat == k, v)
    return out


def classify(df: DataFrame, text_col: str = "comment", whole_words: bool = False) -> DataFrame:
    """All keyword outputs as columns: sentiment, category, sentiment_score, key_issue.

    ``whole_words`` switches from the reference's substring rule ('late' matches
    'plate') to word matches."""
    f = with_keyword_hits(df, text_col, whole_words)
    pos, neg, lt = F.col("_pos"), F.col("_neg"), F.col("_lt")
    return f.select("*", _label(pos, neg).alias("sentiment"), category(lt, whole_words).alias("category"),
                    _score(pos, neg).alias("sentiment_score"),
                    key_issue(lt, whole_words).alias("key_issue")) \
        .drop("_lt", "_pos", "_neg")


def classify_long_texts(df: DataFrame, text_col: str) -> DataFrame:
    """The columns of :func:`classify` (substring rule), each text read once for all words.

    For long texts, where some 60 tests per text cost more than the way to a Python worker; short
    comments are better served by :func:`classify`.
    """
    words = WordMatcher([*POSITIVE_WORDS, *NEGATIVE_WORDS, *(w for _, ws in CATEGORY_RULES for w in ws)])
    masks = words.masks(F.lower(F.col(text_col)))
    rule = issue = F
    for name, ws in CATEGORY_RULES:
        rule = rule.when(words.any(ws), name)
    for w in NEGATIVE_WORDS:
        issue = issue.when(words.has(w), F.lit(w))
    pos, neg = F.col("_pos"), F.col("_neg")
    f = df.withColumns(masks).select("*", words.count(POSITIVE_WORDS).alias("_pos"), words.count(NEGATIVE_WORDS).alias("_neg"))
    return f.select("*", _label(pos, neg).alias("sentiment"), rule.otherwise("other").alias("category"),
                    _score(pos, neg).alias("sentiment_score"), issue.alias("key_issue")).drop(*masks, "_pos", "_neg")


def enrich_reviews(reviews: DataFrame) -> DataFrame:
    """A3: the active output shape: the review columns + sentiment, category, confidence."""
    c = classify(reviews.select(*REVIEW_COLUMNS))
    return c.select(*REVIEW_COLUMNS, "sentiment", "category", confidence("review_id").alias("confidence"))


def review_enriched(reviews: DataFrame, model: str = KEYWORD_MODEL,
                    enriched_at: Column | None = None) -> DataFrame:
    """A4: the mart-shaped table (review_id, sentiment_label, sentiment_score, topic, key_issue, model, enriched_at)."""
    c = classify(reviews.select("review_id", "comment"))
    return c.select(
        F.col("review_id").cast("string").alias("review_id"),
        F.col("sentiment").alias("sentiment_label"),
        "sentiment_score",
        _topic(F.col("category")).alias("topic"),
        "key_issue",
        F.lit(model).alias("model"),
        (enriched_at if enriched_at is not None else F.current_timestamp()).alias("enriched_at"),
    )


def active_to_mart_shape(active: DataFrame) -> DataFrame:
    """Bridge: map rows of the active shape onto the mart shape.

    Label and topic come from the active row; the score and key issue, which the
    active shape does not carry, are derived from the comment with the keyword rules.
    A ``model`` column names whoever labelled the row; without one it was the keyword rules.
    """
    named = active if "model" in active.columns else active.withColumn("model", F.lit(KEYWORD_MODEL))
    f = with_keyword_hits(named.select("review_id", "comment", "sentiment", "category", "model"))
    return f.select(F.col("review_id").cast("string").alias("review_id"),
                    F.col("sentiment").alias("sentiment_label"),
                    _score(F.col("_pos"), F.col("_neg")).alias("sentiment_score"),
                    _topic(F.col("category")).alias("topic"),
                    key_issue(F.col("_lt")).alias("key_issue"), "model",
                    F.current_timestamp().alias("enriched_at"))


def enrich_summary(reviews: DataFrame, done: DataFrame) -> DataFrame:
    """Total reviews with a comment, already enriched (skipped) and new (to process), in one pass."""
    r = reviews.where(F.col("comment").isNotNull()).select("review_id")
    d = done.select("review_id").distinct().withColumn("_done", F.lit(True))
    j = r.join(d, "review_id", "left")
    return j.agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(F.col("_done").isNotNull()).alias("skipped"),
                 F.count_if(F.col("_done").isNull()).alias("processed"))


# ---------------------------------------------------------------- pluggable model
BatchModel = Callable[[pd.Series], pd.DataFrame]

_PLUGGABLE_OUT = T.StructType([
    T.StructField("review_id", T.LongType()), T.StructField("sentiment", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("error", T.StringType())])


def enrich_with_model(reviews: DataFrame, model: BatchModel) -> DataFrame:
    """A5: run a caller-supplied batch classifier over Arrow batches.

    ``model(comments) -> DataFrame[sentiment, category, confidence]`` is called per
    batch; if a batch fails, its rows are retried one by one and rows that still
    fail carry the error text (route them with ``split_rejects``).
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["review_id"].astype("int64").reset_index(drop=True)
            texts = pdf["comment"].reset_index(drop=True)
            try:
                res = model(texts).reset_index(drop=True)
                out = pd.DataFrame({"review_id": ids, "sentiment": res["sentiment"], "category": res["category"],
                                    "confidence": res["confidence"].astype("float64"), "error": None})
            except Exception:  # noqa: BLE001 - isolate the failing rows
                rows = []
                for rid, text in zip(ids, texts):
                    try:
                        one = model(pd.Series([text])).iloc[0]
                        rows.append((rid, one["sentiment"], one["category"], float(one["confidence"]), None))
                    except Exception as exc:  # noqa: BLE001
                        rows.append((rid, None, None, None, f"{type(exc).__name__}: {exc}"))
                out = pd.DataFrame(rows, columns=["review_id", "sentiment", "category", "confidence", "error"])
            yield out

    out = reviews.select(F.col("review_id").cast("bigint"), "comment").mapInPandas(run, _PLUGGABLE_OUT)
    # A model without a confidence of its own gets the key-derived one.
    return out.withColumn("confidence", F.when(F.isnan("confidence") | F.col("confidence").isNull(),
                                               confidence("review_id")).otherwise(F.col("confidence")))


def keyword_model(comments: pd.Series) -> pd.DataFrame:
    """The keyword rules over a whole batch, one vectorised test per word: shows the model hook at work."""
    low = comments.fillna("").astype(str).str.lower()

    def hits(words: list[str]) -> np.ndarray:
        return np.column_stack([low.str.contains(w, regex=False).to_numpy(bool) for w in words])

    tilt = hits(POSITIVE_WORDS).sum(axis=1) - hits(NEGATIVE_WORDS).sum(axis=1)
    names, words = zip(*CATEGORY_RULES)
    return pd.DataFrame({"sentiment": np.select([tilt > 0, tilt < 0], ["positive", "negative"], "neutral"),
                         "category": np.select([hits(w).any(axis=1) for w in words], names, "other"),
                         "confidence": np.nan}, index=comments.index)

def split_rejects(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = results.where(F.col("error").isNull()).drop("error")
    bad = results.where(F.col("error").isNotNull())
    return ok, bad


def parse_model_json(raw: Column | str) -> Column:
    """parse a JSON model answer; unparsable text or a missing key gives NULL fields."""
    schema = T.StructType([T.StructField("sentiment", T.StringType()), T.StructField("category", T.StringType()),
                           T.StructField("confidence", T.DoubleType())])
    return F.from_json(F.col(raw) if isinstance(raw, str) else raw, schema)


NO_ANSWER_TEXT = "Sorry, I cannot classify this review."


def model_answers(reviews: DataFrame, text_col: str = "comment") -> DataFrame:
    """The raw answer text of a JSON-speaking model, derived from the keyword rules.

    A review with a keyword hit gets a JSON object; one without gets prose, which
    the parser has to reject.
    """
    c = classify(reviews.select("review_id", text_col), text_col)
    js = F.to_json(F.struct("sentiment", "category", confidence("review_id").alias("confidence")))
    no_hit = (F.col("sentiment") == "neutral") & (F.col("category") == "other")
    return c.select("review_id", F.when(no_hit, F.lit(NO_ANSWER_TEXT)).otherwise(js).alias("answer"))


def parse_answers(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """parse answers; unparsable text or a missing field marks the row rejected."""
    p = parse_model_json(answer_col)
    ok = p["sentiment"].isNotNull() & p["category"].isNotNull() & p["confidence"].isNotNull()
    return answers.select("review_id", p["sentiment"].alias("sentiment"), p["category"].alias("category"),
                          p["confidence"].alias("confidence"), (~F.coalesce(ok, F.lit(False))).alias("rejected"))


def parse_any_answer(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Answers of either shape, told apart row by row: review_id, shape, sentiment, topic, score, key_issue, rejected.

    ``active`` answers hold sentiment, category and confidence; ``mart`` answers hold sentiment_label, topic and
    sentiment_score, and a key_issue that may be null or absent. A text is parsed once, as a VARIANT, and fields are read by
    path; further fields do not matter. Prose, a null, a missing field or a score that is no number is rejected, with the
    fields that could be read left out.
    """
    rows = answers.select("review_id", F.try_parse_json(F.col(answer_col)).alias("_v"))

    def read(path: str, kind: str) -> Column:
        return F.try_variant_get(F.col("_v"), f"$.{path}", kind)

    rows = rows.select("review_id", *[read(n, k).alias(f"_{n}") for n, k in (
        ("sentiment", "string"), ("category", "string"), ("confidence", "double"),
        ("sentiment_label", "string"), ("topic", "string"), ("sentiment_score", "double"), ("key_issue", "string"))])
    active = F.col("_sentiment").isNotNull() & F.col("_category").isNotNull() & F.col("_confidence").isNotNull()
    mart = F.col("_sentiment_label").isNotNull() & F.col("_topic").isNotNull() & F.col("_sentiment_score").isNotNull()
    shape = F.when(active, "active").when(mart, "mart")
    pick = lambda a, b: F.when(active, F.col(a)).when(mart, F.col(b))
    return rows.select("review_id", shape.alias("shape"), pick("_sentiment", "_sentiment_label").alias("sentiment"),
                       F.when(active, _topic(F.col("_category"))).when(mart, F.col("_topic")).alias("topic"),
                       pick("_confidence", "_sentiment_score").alias("score"),
                       F.when(~active & mart, F.col("_key_issue")).alias("key_issue"), shape.isNull().alias("rejected"))
