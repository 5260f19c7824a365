"""Review retrieval and rule-based answers.

Scoring is one pass over the corpus: blocks of question vectors meet blocks of
rows in matrix products, every task sends at most k ids per question whatever the
corpus size, and a ``row_number() <= k`` window picks the answer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.columns import contains_any
from .newkeys import rows_with_new_keys

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference: the 33 words of the keyword
# vector (a word gives 1.0 when it occurs as a substring of the lower-cased text).
# ---------------------------------------------------------------------------
EMBED_KEYWORDS = ["delivery", "food", "taste", "quality", "packaging", "service", "staff", "price", "expensive",
                  "cheap", "late", "fast", "slow", "cold", "fresh", "restaurant", "order", "refund", "portion",
                  "clean", "dirty", "friendly", "rude", "delay", "missing", "wrong", "good", "great", "excellent",
                  "bad", "terrible", "amazing", "disappointed"]

# Fixed values that must equal the reference: answer rules, first match wins.
ANSWER_DELIVERY_QUESTION = ["delivery", "delivered", "late", "delay"]
ANSWER_DELIVERY_COMMENT = ["late", "slow", "delay", "delivery", "on time", "fast"]
ANSWER_FOOD = ["food", "taste", "quality", "meal"]
ANSWER_PACKAGING = ["packaging", "package"]
ANSWER_SERVICE = ["service", "staff", "employee"]
ANSWER_PRICE = ["price", "expensive", "cheap", "cost"]
ANSWER_RATING = ["rating", "stars", "score"]
TEXT_FOOD = "Based on the most relevant reviews, customers mainly discuss food taste, freshness, and overall quality."
TEXT_PACKAGING = "The relevant reviews mention packaging quality and how the food was packaged during delivery."
TEXT_SERVICE = "The relevant reviews discuss customer service and staff experience."
TEXT_PRICE = "The relevant reviews contain comments about pricing and perceived value."
TEXT_NO_DELIVERY = "The provided reviews do not contain enough information about delivery."

# Example questions for batch retrieval (our own; any question table works).
EXAMPLE_QUESTIONS = [
    "How is the delivery speed?",
    "What do customers say about the food quality?",
    "Is the packaging good?",
    "How is the staff service?",
    "Is it too expensive?",
    "What is the average rating?",
    "Anything else worth knowing?",
]

TOP_K = 5
# Query vectors one task scores at a time, and corpus rows it scores them against: the size
# of a block, not a limit; larger sets are dealt in more blocks.
QUERY_BLOCK, ROW_BLOCK = 1024, 20_000


def keyword_vector(text: Column | str) -> Column:
    """33-element 0/1 vector of keyword occurrence."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.array(*[t.contains(w).cast("double") for w in EMBED_KEYWORDS])


def keyword_batch(texts: pd.Series) -> list[list[float]]:
    """A6 over a batch, one vectorised test per word: shows the model hook at work."""
    low = texts.fillna("").str.lower()
    return np.column_stack([low.str.contains(w, regex=False).to_numpy(float) for w in EMBED_KEYWORDS]).tolist()


def review_vectors(reviews_stg: DataFrame, model: Callable[[pd.Series], list[list[float]]] | None = None) -> DataFrame:
    """The embedded review corpus: review_id, city, rating, comment, embedding (keyword vectors, or the caller's model)."""
    rows = reviews_stg.where(F.col("comment").isNotNull()).select(
        "review_id", "city", "rating", F.col("comment").cast("string").alias("comment"))
    if model is None:
        return rows.withColumn("embedding", keyword_vector("comment"))
    return embed_with_model(rows, "comment", model, ["review_id", "city", "rating", "comment"])


def cached_vectors(spark: SparkSession, path: str, reviews: DataFrame, embed: Callable[[DataFrame], DataFrame],
                   version: str | None = None, key: str = "review_id") -> DataFrame:
    """The embedded corpus kept under ``path``; only reviews without a vector there are embedded.

    Each refresh writes a folder of its own and logs it afterwards, and readers take
    logged folders only, so a broken or half-written refresh is embedded again and
    never served. ``version`` (e.g. the model's name) keeps the vectors of different
    models apart. An error while writing is an error.
    """
    root = path.rstrip("/") + (f"/version={version}" if version is not None else "")
    try:
        parts = [r.folder for r in spark.read.schema("folder string").json(f"{root}/_parts").distinct().collect()]   # one row per refresh
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        parts = []
    new = reviews if not parts else rows_with_new_keys(reviews, spark.read.parquet(*parts).select(key), key)
    folder = f"{root}/part-{uuid.uuid4().hex[:12]}"
    embed(new).write.parquet(folder)
    if not parts or not spark.read.parquet(folder).isEmpty():
        spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.mode("append").json(f"{root}/_parts")
        parts.append(folder)
    return spark.read.parquet(*parts)


def embed_with_model(texts: DataFrame, text_col: str, model: Callable[[pd.Series], list[list[float]]],
                     key_cols: list[str]) -> DataFrame:
    """Pluggable batch embedding over Arrow batches; output ``embedding array<double>``."""
    schema = T.StructType([f for f in texts.select(*key_cols).schema.fields]
                          + [T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[key_cols].copy()
            out["embedding"] = [list(map(float, v)) for v in model(pdf[text_col])]
            yield out

    return texts.select(*dict.fromkeys([*key_cols, text_col])).mapInPandas(run, schema)


# ------------------------------------------------------------------ scoring
# One rule everywhere: the cosine of two vectors of equal length without null or
# non-finite parts, 0 if either is all zeros; any other pair has no score and no row.
def top_k(scored: DataFrame, k: int, order_key: str, part: str = "query_id") -> DataFrame:
    """Best k per query by score (ties: smaller ``order_key`` first)."""
    w = Window.partitionBy(part).orderBy(F.col("score").desc(), F.col(order_key).asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def round_half_away(x: np.ndarray, digits: int) -> np.ndarray:
    """Scale, round half away from zero, unscale (the SQL engines' double rounding)."""
    m = 10.0 ** digits
    y = x * m
    return np.where(y < 0, -np.floor(-y + 0.5), np.floor(y + 0.5)) / m


def _usable(vectors) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and matrix of the usable vectors of each length."""
    by: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            by.setdefault(len(v), []).append(i)
    out = {}
    for width, at in by.items():
        m = np.array([np.asarray(vectors[i], dtype=np.float64) for i in at])
        ok = np.isfinite(m).all(axis=1)
        out[width] = np.array(at)[ok], m[ok]
    return out


def _block_scores(queries: list, rows: pd.DataFrame, id_col: str, vec_col: str, k: int | None, digits: int | None) -> pd.DataFrame:
    """Scores of a block of (query id, vector) against a block of rows: the best ``k`` per query, or all."""
    qs, vs = _usable([v for _, v in queries]), _usable(rows[vec_col].to_list())
    parts = []
    for width in qs.keys() & vs.keys():
        (qi, q), (at, m) = qs[width], vs[width]
        ids = rows[id_col].iloc[at]
        place = np.empty(len(at), dtype=np.int64)
        place[np.argsort(ids.to_numpy(), kind="stable")] = np.arange(len(at))
        norm = np.sqrt((m * m).sum(axis=1))[:, None] * np.sqrt((q * q).sum(axis=1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(norm == 0, 0.0, (m @ q.T) / norm)
        if digits is not None:
            score = round_half_away(score, digits)
        for j, i in enumerate(qi):
            best = np.arange(len(at)) if k is None else np.lexsort((place, -score[:, j]))[:k]
            part = rows.iloc[at[best]].drop(columns=[vec_col])
            part.insert(0, "query_id", [queries[i][0]] * len(best))
            part.insert(1, "score", score[best, j])
            parts.append(part)
    return pd.concat(parts, ignore_index=True) if parts else rows.iloc[:0].drop(columns=[vec_col]).assign(query_id=None, score=None)


def _best(found: pd.DataFrame, id_col: str, k: int | None) -> pd.DataFrame:
    if k is None or found.empty:
        return found
    found = found.sort_values(["score", id_col], ascending=[False, True], kind="stable")
    return found.groupby("query_id", sort=False, dropna=False).head(k)


def _scored(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_id: str, query_vec: str,
            k: int | None, keep: list[str], digits: int | None) -> DataFrame:
    """(query_id, score, id, keep ...) of every query with the rows, in one pass over the corpus.

    Up to one block of queries travels to the tasks, and each keeps a running best
    k. More queries are dealt in blocks by a hash, every row meets every block
    once, and no task holds more than one block of each side.
    """
    from ..session import scratch_path
    spark = corpus.sparkSession
    staged = scratch_path(spark, "query-vectors")                # computed once, e.g. centroids
    queries.select(F.col(query_id).alias("_q"), F.col(query_vec).cast("array<double>").alias("_v")).distinct().write.parquet(staged)
    q = spark.read.parquet(staged)
    src = corpus.select(id_col, F.col(vec_col).cast("array<double>").alias(vec_col), *keep)
    fields = {f.name: f for f in src.schema.fields}
    schema = T.StructType([T.StructField("query_id", q.schema["_q"].dataType), T.StructField("score", T.DoubleType()), fields[id_col]]
                          + [fields[c] for c in keep])
    names = schema.names
    n = q.count()
    if n <= QUERY_BLOCK:
        block = [(r[0], r[1]) for r in q.collect()]

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for pdf in batches:
                found = _block_scores(block, pdf, id_col, vec_col, k, digits)[names]
                if k is None:
                    yield found
                else:
                    best = _best(found if best is None else pd.concat([best, found]), id_col, k)
            if best is not None:
                yield best[names]
        return src.mapInPandas(scan, schema)

    blocks, chunks = -(-n // QUERY_BLOCK), max(1, -(-src.select(id_col).count() // ROW_BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = q.withColumn("_block", F.pmod(F.xxhash64("_q", "_v"), F.lit(blocks)).cast("int")).withColumn("_chunk", every(chunks))
    right = src.withColumn("_chunk", F.pmod(F.xxhash64(id_col, vec_col), F.lit(chunks)).cast("int")).withColumn("_block", every(blocks))

    def meet(qs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return _block_scores(list(zip(qs["_q"], qs["_v"])), rows[[id_col, vec_col, *keep]], id_col, vec_col, k, digits)[names]
    return left.groupBy("_chunk", "_block").cogroup(right.groupBy("_chunk", "_block")).applyInPandas(meet, schema)


def cosine_topk_all(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_id: str,
                    query_vec: str, k: int = TOP_K, keep: list[str] | None = None,
                    digits: int | None = None) -> DataFrame:
    """Exact top-k rows per query by cosine similarity, ties by smaller id, for any number of queries.

    Query ids may be of any type; a null id is an id like another, and a repeated
    (id, vector) counts once. Tasks send ids and scores only; the kept columns
    of the answer are joined back by id.
    """
    found = top_k(_scored(corpus, id_col, vec_col, queries, query_id, query_vec, k, [], digits), k, id_col)
    if not keep:
        return found
    rows = corpus.select(F.col(id_col).alias("_id"), *keep)
    return found.join(rows, found[id_col].eqNullSafe(rows["_id"]), "left").select("query_id", id_col, "score", *keep, "rank")


def cosine_topk(corpus: DataFrame, id_col: str, vec_col: str, queries: list[tuple], k: int = TOP_K,
                keep: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """``cosine_topk_all`` for a short list of (id, vector)."""
    spark = corpus.sparkSession
    if not queries:
        qdf = spark.createDataFrame([], "q int, v array<double>")
    else:
        qdf = spark.createDataFrame([(q, [float(x) for x in v]) for q, v in queries], ["q", "v"])
        if isinstance(queries[0][0], int):
            qdf = qdf.withColumn("q", F.col("q").cast("int"))
    return cosine_topk_all(corpus, id_col, vec_col, qdf, "q", "v", k, keep, digits)


def score_against_all(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_id: str, query_vec: str,
                      score_digits: int | None = None) -> DataFrame:
    """(query_id, score, id) of every row and query that have a cosine."""
    return _scored(corpus, id_col, vec_col, queries, query_id, query_vec, None, [], score_digits)


# ------------------------------------------------------------------ classes of equal vectors
def vector_classes(corpus: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(vec, members, firsts, class): each distinct vector once, its number of rows and its ``k`` smallest ids, staged.

    Two partial aggregations: a task sends one count, and at most k ids, per vector,
    however many of its rows share it.
    """
    from ..session import scratch_path
    rows = corpus.select(F.col(vec_col).cast("array<double>").alias("vec"), F.col(id_col).alias("id")).where("vec IS NOT NULL")
    counts = rows.groupBy("vec").agg(F.count("*").alias("members"))
    w = Window.partitionBy("vec").orderBy(F.col("id").asc())
    firsts = rows.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("firsts"))
    path = scratch_path(corpus.sparkSession, "vector-classes")
    counts.join(firsts, "vec").withColumn("class", F.monotonically_increasing_id()).write.parquet(path)
    return corpus.sparkSession.read.parquet(path)


def class_topk(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_id: str, query_vec: str,
               k: int = TOP_K, keep: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """``cosine_topk_all`` for a corpus with few distinct vectors: a vector is scored once, whatever its number of rows.

    Of a query's classes, those count whose strictly better classes hold fewer than k rows; only they are
    expanded, to k ids each. Same rows, scores and ranks as row by row. Ids must not be null.
    """
    classes = vector_classes(corpus, id_col, vec_col, k)
    scored = _scored(classes, "class", "vec", queries, query_id, query_vec, None, [], digits)
    sized = scored.join(classes.select("class", "members", "firsts"), "class")
    upto = Window.partitionBy("query_id").orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = sized.withColumn("_upto", F.sum("members").over(upto)).withColumn("_here", F.sum("members").over(Window.partitionBy("query_id", "score"))) \
        .where(F.col("_upto") - F.col("_here") < k)
    found = top_k(near.select("query_id", "score", F.explode("firsts").alias(id_col)), k, id_col)
    if not keep:
        return found.select("query_id", "score", id_col, "rank")
    rows = corpus.select(F.col(id_col).alias("_id"), *keep)
    return found.join(rows, found[id_col].eqNullSafe(rows["_id"]), "left").select("query_id", id_col, "score", *keep, "rank")


def best_query_each(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_id: str, query_vec: str) -> DataFrame:
    """(id, query_id, score): the query nearest to each row (ties: smaller query id); rows without a score are left out.

    One row per row of the corpus, not one per pair: distinct vectors are scored, and rows meet the answer of their vector.
    """
    from ..session import scratch_path
    classes = vector_classes(corpus, id_col, vec_col, 1)
    scored = _scored(classes, "class", "vec", queries, query_id, query_vec, None, [], None)
    best = scored.groupBy("class").agg(F.min_by(F.struct("query_id", "score"), F.struct(-F.col("score"), F.col("query_id"))).alias("b"))
    path = scratch_path(corpus.sparkSession, "class-answers")
    classes.join(best, "class").select("vec", "b.query_id", "b.score").write.parquet(path)
    answers = corpus.sparkSession.read.parquet(path)                # its size is known: broadcast if small, else sort-merge with skew split
    return corpus.select(id_col, F.col(vec_col).cast("array<double>").alias("vec")).join(answers, "vec").select(id_col, "query_id", "score")


def retrieve(corpus: DataFrame, questions: DataFrame, k: int = TOP_K,
             model: Callable[[pd.Series], list[list[float]]] | None = None) -> DataFrame:
    """A8 + A9: top-k reviews per question (query_id, review columns, score, rank).

    ``model`` must be the one that embedded the corpus; without it both are keyword vectors."""
    if model is None:
        qv = questions.select("question_id", keyword_vector("question").alias("v"))
    else:
        qv = embed_with_model(questions, "question", model, ["question_id"]).withColumnRenamed("embedding", "v")
    # Keyword vectors are few however many reviews there are; a model's are nearly all distinct.
    top = class_topk if model is None else cosine_topk_all
    return top(corpus, "review_id", "embedding", qv, "question_id", "v", k, keep=["city", "rating", "comment"])


# ------------------------------------------------------------------ answers
def answer(question: Column, n_top: Column, n_delivery: Column, avg_rating: Column) -> Column:
    """A10: rule-based answer from the question text and aggregates of its top reviews."""
    q = F.lower(question)
    delivery = F.when(n_delivery > 0, F.format_string(
        "Based on the %s most relevant reviews, delivery is mainly discussed in terms of timeliness and speed.",
        n_delivery)).otherwise(F.lit(TEXT_NO_DELIVERY))
    rating = F.format_string("The average rating among the %s most relevant reviews is %s stars.",
                             n_top, F.coalesce(F.round(avg_rating, 2).cast("string"), F.lit("None")))
    default = F.format_string(
        "I found %s relevant reviews, but the mock AI cannot provide a detailed answer to this question yet.", n_top)
    return (F.when(contains_any(q, ANSWER_DELIVERY_QUESTION), delivery)
            .when(contains_any(q, ANSWER_FOOD), F.lit(TEXT_FOOD))
            .when(contains_any(q, ANSWER_PACKAGING), F.lit(TEXT_PACKAGING))
            .when(contains_any(q, ANSWER_SERVICE), F.lit(TEXT_SERVICE))
            .when(contains_any(q, ANSWER_PRICE), F.lit(TEXT_PRICE))
            .when(contains_any(q, ANSWER_RATING), rating)
            .otherwise(default))


def answer_questions(top: DataFrame, questions: DataFrame) -> DataFrame:
    """One answer per question from its (at most k) top reviews."""
    agg = top.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_top"),
        F.count_if(contains_any(F.lower("comment"), ANSWER_DELIVERY_COMMENT)).alias("n_delivery"),
        F.avg("rating").alias("avg_rating"))
    j = questions.join(agg, questions["question_id"] == agg["query_id"], "left")
    n_top = F.coalesce(F.col("n_top"), F.lit(0))
    return j.select("question_id", "question",
                    answer(F.col("question"), n_top, F.coalesce(F.col("n_delivery"), F.lit(0)),
                           F.col("avg_rating")).alias("answer"))


def build_context(top: DataFrame, questions: DataFrame) -> DataFrame:
    """Prompt text per question: '(city, rating stars) comment' lines in rank order."""
    line = F.format_string("(%s, %s stars) %s\n", F.coalesce(F.col("city"), F.lit("None")),
                           F.coalesce(F.col("rating").cast("string"), F.lit("None")), F.col("comment"))
    ctx = top.groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("rank"), line.alias("line")))),
                                 lambda s: s["line"]), "").alias("context"))
    j = questions.join(ctx, questions["question_id"] == ctx["query_id"], "left")
    context = F.coalesce(F.col("context"), F.lit(""))
    return j.select("question_id", "question", context.alias("context"),
                    F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\nReviews:\n"), context)
                    .alias("prompt"))


def questions_frame(spark: SparkSession, questions: list[str] = EXAMPLE_QUESTIONS) -> DataFrame:
    return spark.createDataFrame([(i + 1, q) for i, q in enumerate(questions)], "question_id int, question string")


def label_centroids(vectors: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Per-label mean vector (label, v), computed on Spark and staged in the shared folder.

    One hash aggregation with an ``avg`` per position (partial sums before the
    shuffle); no row is exploded into one row per element. The width is taken
    from one row and checked by the same aggregation (largest size per label);
    only ragged vectors cost a second pass.
    """
    from ..session import scratch_path
    v = F.col(vec_col)
    first = vectors.select(F.size(v)).limit(1).first()
    width = max(first[0], 0) if first else 0

    def centroids(w: int) -> DataFrame:
        out = scratch_path(vectors.sparkSession, "centroids")
        vectors.groupBy(label_col).agg(
            F.array(*[F.avg(F.try_element_at(v, F.lit(i + 1)).cast("double")) for i in range(w)]).alias("v"),
            F.max(F.size(v)).alias("_w")).write.parquet(out)
        return vectors.sparkSession.read.parquet(out)

    cents = centroids(width)
    widest = cents.agg(F.max("_w")).first()[0]   # one row per label
    if widest is not None and widest > width:
        cents = centroids(widest)
    return cents.drop("_w")


def nearest_to_centroids(vectors: DataFrame, k: int = TOP_K, id_col: str = "vec_id", label_col: str = "label",
                         vec_col: str = "embedding", digits: int = 6) -> DataFrame:
    """Top-k vectors by cosine similarity to each label's centroid (scores rounded)."""
    cents = label_centroids(vectors, label_col, vec_col)
    top = cosine_topk_all(vectors, id_col, vec_col, cents, label_col, "v", k, keep=[label_col], digits=digits)
    return top.select("query_id", "rank", id_col, label_col, "score")
