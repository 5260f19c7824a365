"""Quality rules: robust multivariate outliers of document statistics, per language and source.

Each document becomes a vector of transformed statistics. For every (language,
source) a minimum-covariance-determinant estimate describes the bulk of the
vectors; documents whose Mahalanobis distance from it is beyond a chi-square
quantile are rejected. Everything is DataFrame expressions: vectors are fixed-point
integers, so copies collapse into weighted cells, sums are exact, and results do
not depend on the order of rows.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, let, stage

WINDOW = 8   # words of a repeated passage

#: The vector: name, and the scale below which a spread counts as this much (in natural-log units). A statistic that
#: hardly varies in a group (most documents have no symbols at all) would otherwise reject any document that differs.
#: The scales leave every statistic room to reject alone: its extreme is more than sqrt(chi_square(D, REJECT_Z)) scales away.
VECTOR = {
    "v_words": 0.5,      # ln words
    "v_length": 0.15,    # ln mean word length
    "v_symbols": 0.4,    # ln (1 + symbols per 100 characters)
    "v_lines": 0.5,      # ln (1 + repeated lines per 100 lines)
    "v_repeats": 0.4,    # ln (1 + words in repeated passages per 100 words)
    "v_distinct": 0.25,  # ln distinct words per word
    "v_other": 0.3,      # ln (1 + characters that are no letters, per 100)
    "v_upper": 0.4,      # ln (1 + capitals per 100 characters)
}
D = len(VECTOR)
#: Fixed-point steps per unit of the vector.
STEPS = 256
#: Part of a group that the estimate must cover; concentration steps; documents below which a group is pooled.
COVER, CONCENTRATIONS, MIN_GROUP = 0.75, 8, 20 * D
#: Normal quantile of the rejection level (one in about 30,000 regular documents).
REJECT_Z = 4.0
#: Distance bins per doubling of the squared distance.
BINS = 64


def chi_square(d: int, z: float) -> float:
    """Wilson-Hilferty quantile of the chi-square distribution at the normal quantile ``z``."""
    return d * (1 - 2 / (9 * d) + z * math.sqrt(2 / (9 * d))) ** 3


# ------------------------------------------------------------------ statistics of one document
def _repeat_words(words: Column) -> Column:
    """Words inside passages of ``WINDOW`` words that occur twice or more, first occurrence included."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)])))

    def covered(v: Column) -> Column:
        ordered = F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda e, n: F.coalesce(e["x"] == F.get(s, n - 1)["x"], F.lit(False)) | F.coalesce(e["x"] == F.get(s, n + 1)["x"], F.lit(False))))
        starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
        return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
                           lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n")))["n"]

    counted = let(windows, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0).cast("long")).otherwise(covered(v)))
    return F.when(F.size(words) >= WINDOW, counted).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of every whole text: n_words, n_distinct, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_letters, n_upper."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    only = lambda keep: F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
                                             F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
                                             _repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))  # noqa: E731  null is a value of its own
    return docs.select(F.col(id_col).alias("doc_id"), key(lang_col).alias("lang"), key(source_col).alias("source"),
                       of_words.alias("w"), of_lines.alias("l"), only(r"#*$%&|<>").alias("n_symbols"), only(r"\p{L}").alias("n_letters"),
                       only(r"\p{Lu}").alias("n_upper")).select("doc_id", "lang", "source", "w.*", "l.*", "n_symbols", "n_letters", "n_upper")


def vectors(stats: DataFrame) -> DataFrame:
    per = lambda n, of: F.log1p(100 * F.col(n) / F.greatest(F.col(of), F.lit(1)))
    values = {"v_words": F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double")),
              "v_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
              "v_symbols": per("n_symbols", "word_chars"), "v_lines": per("n_dup_lines", "n_lines"), "v_repeats": per("n_repeat_words", "n_words"),
              "v_distinct": F.log(F.greatest(F.col("n_distinct"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
              "v_other": F.log1p(100 * F.greatest(F.col("word_chars") - F.col("n_letters"), F.lit(0)) / F.greatest(F.col("word_chars"), F.lit(1))),
              "v_upper": per("n_upper", "word_chars")}
    return stats.withColumns({k: F.round(v * STEPS).cast("long") for k, v in values.items()})


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


# ------------------------------------------------------------------ minimum covariance determinant
def _inverse(cov: Column) -> Column:
    """(p: inverse, logdet) of a symmetric positive matrix held row by row, by Gauss-Jordan sweeps."""
    def sweep(state: Column, k: Column) -> Column:
        a = state["p"]
        pivot = a[k * D + k]

        def cell(n: Column) -> Column:
            i, j = F.floor(n / D).cast("int"), n % D
            return F.when((i == k) & (j == k), 1 / pivot).when(i == k, a[n] / pivot).when(j == k, -a[n] / pivot) \
                .otherwise(a[n] - a[i * D + k] * a[k * D + j] / pivot)
        return F.struct(F.transform(F.sequence(F.lit(0), F.lit(D * D - 1)), cell).alias("p"), (state["logdet"] + F.log(pivot)).alias("logdet"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(D - 1)), F.struct(cov.alias("p"), F.lit(0.0).alias("logdet")), sweep)


_NAMES = list(VECTOR)
_PAIRS = list(combinations_with_replacement(range(D), 2))


def _moments(cells: DataFrame, *by: str) -> DataFrame:
    """n, center and covariance (with the least spread of each statistic added) of weighted cells; the sums are exact integers."""
    c = F.col("c")
    sums = cells.groupBy(*by).agg(F.sum("c").alias("n"), *[F.sum(F.col(v) * c).alias(f"s{i}") for i, v in enumerate(_NAMES)],
                                  *[F.sum(F.col(_NAMES[i]) * F.col(_NAMES[j]) * c).cast("double").alias(f"s{i}_{j}") for i, j in _PAIRS])
    n = F.col("n")
    mean = {i: F.col(f"s{i}") / n for i in range(D)}
    least = [(s * STEPS) ** 2 for s in VECTOR.values()]
    entry = lambda i, j: F.col(f"s{min(i, j)}_{max(i, j)}") / n - mean[i] * mean[j] + (least[i] if i == j else 0)
    return sums.select(*by, "n", F.array(*[mean[i] for i in range(D)]).alias("m"), F.array(*[entry(i, j) for i in range(D) for j in range(D)]).alias("cov"))


def _estimate(moments: DataFrame, *by: str) -> DataFrame:
    return moments.withColumn("inv", _inverse(F.col("cov"))).select(*by, "m", "inv.p", "inv.logdet")


def _distance() -> Column:
    """Squared Mahalanobis distance of the row's vector from center ``m`` with inverse covariance ``p``."""
    z = [F.col(v) - F.col("m")[i] for i, v in enumerate(_NAMES)]
    return sum(((1 if i == j else 2) * F.col("p")[i * D + j] * z[i] * z[j] for i, j in _PAIRS), F.lit(0.0))


def _bin() -> Column:
    return F.floor(F.log2(F.greatest(_distance(), F.lit(1e-6))) * BINS).cast("int")


def _quantile_bins(cells: DataFrame, estimates: DataFrame, share: float, name: str) -> DataFrame:
    """Per group and start: the least distance bin at or below which ``share`` of the documents lie."""
    bins = cells.join(estimates, ["lang", "source"]).groupBy("lang", "source", "start", _bin().alias("bin")).agg(F.sum("c").alias("c"))
    w = Window.partitionBy("lang", "source", "start")   # a few thousand bins at most, whatever the group's size
    return bins.withColumns({"upto": F.sum("c").over(w.orderBy("bin")), "n": F.sum("c").over(w)}) \
        .where(F.col("upto") >= F.ceil(F.col("n") * share)).groupBy("lang", "source", "start").agg(F.min("bin").alias(name))


def _medians(cells: DataFrame) -> DataFrame:
    """Start from each statistic's median and quartiles, exactly, over its integer histogram."""
    long = cells.select("lang", "source", "c", F.posexplode(F.array(*_NAMES)).alias("dim", "v"))
    hist = long.groupBy("lang", "source", "dim", "v").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("lang", "source", "dim")     # one row per fixed-point value
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * q), F.col("v")))
    spread = hist.withColumns({"upto": F.sum("c").over(w.orderBy("v")), "n": F.sum("c").over(w)}).groupBy("lang", "source", "dim") \
        .agg(at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("sd"))
    pick = lambda c, i: F.max(F.when(F.col("dim") == i, F.col(c)))
    least = [(s * STEPS) ** 2 for s in VECTOR.values()]
    diag = [F.pow(pick("sd", i), F.lit(2)) + least[i] for i in range(D)]
    return spread.groupBy("lang", "source").agg(F.array(*[pick("mid", i).cast("double") for i in range(D)]).alias("m"),
                                                F.array(*[diag[i] if i == j else F.lit(0.0) for i in range(D) for j in range(D)]).alias("cov"))


def robust_estimates(cells: DataFrame) -> DataFrame:
    """Per (lang, source): center ``m``, inverse covariance ``p`` and ``half``, the median bin of its distances.

    Two deterministic starts (medians with quartile spreads; mean with covariance)
    are concentrated: each step keeps the ``COVER`` nearest documents of a group
    and takes their mean and covariance. The start that ends with the smaller
    determinant wins, the medians on a tie.
    """
    starts = _medians(cells).withColumn("start", F.lit(0)).unionByName(_moments(cells, "lang", "source").drop("n").withColumn("start", F.lit(1)))
    now = stage(_estimate(starts, "lang", "source", "start"), "mcd")
    for _ in range(CONCENTRATIONS):
        cut = stage(_quantile_bins(cells, now, COVER, "cut"), "mcd-cut")
        near = cells.join(now.join(cut, ["lang", "source", "start"]), ["lang", "source"]).where(_bin() <= F.col("cut"))
        now = stage(_estimate(_moments(near, "lang", "source", "start"), "lang", "source", "start"), "mcd")
    best = now.groupBy("lang", "source").agg(F.min(F.struct("logdet", "start")).alias("b")).select("lang", "source", "b.start")
    best = now.join(best, ["lang", "source", "start"])
    return best.join(_quantile_bins(cells, best, 0.5, "half"), ["lang", "source", "start"]).select("lang", "source", "m", "p", "half")


def _pooled(cells: DataFrame) -> DataFrame:
    """(lang, source) -> (group_lang, group_source) and its documents: groups that are too small share one per language, then one for all."""
    small = F.col("n") < MIN_GROUP
    n = cells.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    n = n.withColumn("group_source", F.when(small, F.lit("*")).otherwise(F.col("source")))
    per = n.groupBy(F.col("lang").alias("l"), F.col("group_source").alias("s")).agg(F.sum("n").alias("pool"))
    n = n.join(per, (F.col("lang") == F.col("l")) & (F.col("group_source") == F.col("s")))
    n = n.select("lang", "source", "n", F.when(F.col("pool") < MIN_GROUP, F.lit("*")).otherwise(F.col("lang")).alias("group_lang"), "group_source")
    whole = n.groupBy(F.col("group_lang").alias("l"), F.col("group_source").alias("s")).agg(F.sum("n").alias("group_n"))
    return n.join(whole, (F.col("group_lang") == F.col("l")) & (F.col("group_source") == F.col("s"))).select("lang", "source", "group_lang", "group_source", "group_n")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: counts, base_failed, kept and the squared robust distance over its limit.

    Null texts are empty (and fail the base rule). A null language or source is a
    value of its own. Groups below ``MIN_GROUP`` documents are pooled per language,
    then together; if even that is too small, only the base rule decides.
    Repeated rows are judged alike. Columns other than the four named are not read.
    """
    rows = stage(vectors(statistics(docs, id_col, text_col, lang_col, source_col)).withColumn("base_failed", base_failed()), "quality-stats")
    cells = rows.where(~F.col("base_failed")).groupBy("lang", "source", *_NAMES).agg(F.count("*").alias("c"))
    groups = stage(_pooled(cells), "quality-groups")
    # Groups that are too small go here, before the cells are staged, so nothing later is dealt by group.
    cells = cells.join(groups.where(F.col("group_n") >= MIN_GROUP), ["lang", "source"]).drop("lang", "source", "group_n") \
        .withColumnsRenamed({"group_lang": "lang", "group_source": "source"})
    cells = stage(cells.groupBy("lang", "source", *_NAMES).agg(F.sum("c").alias("c")), "quality-cells")
    fit = stage(robust_estimates(cells), "quality-fit")
    # Distances whose median is above the chi-square median are scaled back to it; where least spreads keep them
    # below, the quantile itself is the limit.
    limit = F.greatest(F.pow(F.lit(2.0), (F.col("half") + 1) / BINS) / chi_square(D, 0.0), F.lit(1.0)) * chi_square(D, REJECT_Z)
    limits = groups.join(fit.select(F.col("lang").alias("group_lang"), F.col("source").alias("group_source"), "m", "p", limit.alias("limit")),
                         ["group_lang", "group_source"]).select("lang", "source", "m", "p", "limit")
    far = F.coalesce(_distance() / F.col("limit"), F.lit(0.0))
    return rows.join(limits, ["lang", "source"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (far <= 1)).alias("kept"), F.round(far, 6).alias("distance"))
