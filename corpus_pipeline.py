"""Training-data pipeline over ``documents``: each stage works on all rows its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns
the documents it keeps, with the columns of documents, except the last, which
returns token ids. ``run`` writes every stage to the shared folder and reads it
back, so a lost executor never costs more than the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tiffin.llm import langid, minhash, mixing, nbest, pii
from tiffin.llm.common import free_name, small_batches, stage, table

#: Documents whose best language covers less than this share of their n-grams are in none of the languages.
MIN_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language; a missing ``lang`` becomes the predicted one."""
    small_batches(spark)
    names = docs.columns
    model = langid.train(langid.learnable(docs))
    said = langid.identify(docs, model, pred_col="__lang", score_col="__score")
    kept = said.where((F.col("__lang") != "und") & (F.col("__score") >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document (by id) of each near-duplicate group: five-word shingles, similarity 0.8 or more.

    Of rows that repeat an id, whatever their texts, one stays: the first by source, language and md5 of the text. Rows
    without an id are compared as wholes only: of those with one text (or none), the first stays in the same way.
    """
    names = docs.columns
    gone = minhash.near_duplicates(docs, percent=80, width=5).where(~F.col("kept")).select("doc_id")
    kept = docs.join(stage(gone, "dedup-gone"), "doc_id", "left_anti").select(*names)
    key, order = free_name(names, "__key"), free_name(names, "__order")
    # The few repeated rows are told apart by their keys, so no text is shuffled for the others.
    keyed = kept.withColumn(key, F.when(F.col("doc_id").isNull(), F.concat(F.lit("text "), F.coalesce(F.md5("text"), F.lit("none"))))
                            .otherwise(F.col("doc_id").cast("string")))
    again = stage(keyed.groupBy(key).count().where("count > 1").select(key), "dedup-again")
    first = Window.partitionBy(key).orderBy("source", "lang", F.md5("text"))
    # row_number() = 1 keeps one row of a key in each task before the shuffle.
    one = keyed.join(again, key, "left_semi").withColumn(order, F.row_number().over(first)).where(F.col(order) == 1)
    return keyed.join(again, key, "left_anti").select(*names).unionAll(one.select(*names))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind."""
    small_batches(spark)
    return pii.redact(docs, pii.train(docs))


def mixing_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the expected tokens per domain meet the targets."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the best segmentation by the pieces' frequencies in ``docs``, and score and digest of the four best."""
    import public_tokenizers
    small_batches(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    return nbest.encode(docs, model, n=4, counts=nbest.piece_counts(docs, model), remembered=300_000, keep_words=False)


STAGES = [("language_id", language_id), ("minhash_near_dedup", near_dedup), ("personal_data", personal_data),
          ("mixing", mixing_rates), ("sentencepiece", sentence_pieces)]

#: No SQL can express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
