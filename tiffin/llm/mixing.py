"""Mixing to target weights with soft memberships.

A classifier learned from the labels table gives every document a posterior over
domains. Document rates (expected numbers of copies) are then fitted by
nonnegative least squares, so that the expected tokens per domain meet their
targets, with a small pull of every rate towards one that keeps the corpus varied.
The fit is an accelerated projected gradient over the cells of equal posteriors.
DataFrame expressions do all the work; the driver sees bounded things only:
word-bucket counts of the labelled sample and a few sums per step of the fit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, let, stage

#: Domains, most wanted first, and their target shares of the tokens kept; tokens kept per token of input. Posteriors of
#: a document never leave toxic out, so shares must lie in what mixtures of posteriors span.
TARGETS = {"high": 0.76, "low": 0.08, "toxic": 0.16}
BUDGET = 0.95
#: Labelled documents learned from, at most about (picked by a hash of the id); a fifth of them sets the temperature.
MAX_LABELLED = 6000
#: Word buckets of the classifier; integer steps per unit of log-likelihood; a bucket counts as evidence if its document
#: shares in two domains differ by this many standard errors.
BUCKETS, UNIT, EVIDENT = 16384, 1024, 6.0
#: Posteriors are multiples of 1 / GRID, so documents fall into a bounded number of cells with equal rates.
GRID = 200
#: Pull of the rates towards one, against the totals' own weight of one: it costs about a thousandth of a domain's total and
#: keeps rates from running to the few documents at the edge of what the posteriors span. Rates have no upper bound.
PULL, MAX_RATE = 1e-3, math.inf
#: Steps of the fit at most, and the largest move of a rate that ends it.
STEPS, SETTLED = 200, 1e-4
#: Copies of a row that are made at once; more are dealt over the tasks first.
COPIES = 64

DOMAINS = list(TARGETS)


def label_domain() -> Column:
    """Domain of a row of the labels table; null without a usable label."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), f"[{SPACE}]+"), lambda w: w != "")


def _buckets(words: Column) -> Column:
    """Distinct buckets of a text, two per word: the word without its last mark, and its last character."""
    bucket = lambda c, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(BUCKETS)).cast("int")
    return F.array_distinct(F.concat(F.transform(words, lambda w: bucket(F.rtrim(w, F.lit(".,;:!?")), 1)), F.transform(words, lambda w: bucket(F.right(w, F.lit(1)), 2))))


@dataclass
class Classifier:
    """Bucketed naive Bayes over telling words, with a temperature per domain: logit = log prior + heat * log-likelihood ratio."""

    prior: list[float]            # per domain
    weights: list[list[int]]      # per domain but the first: log-likelihood ratio to the first, in 1 / UNIT, per bucket
    heats: tuple[float, ...] = ()

    def evidence(self, text_col: str = "text") -> Column:
        """struct(n, s1, s2, ...): words of the text and its summed weights, exact integers."""
        tables = [F.split(F.lit(",".join(map(str, w))), ",").cast("array<bigint>") for w in self.weights]

        def total(buckets: Column, weight: Column) -> Column:
            return F.aggregate(buckets, F.lit(0).cast("long"), lambda a, x: a + weight[x])

        def summed(words: Column) -> Column:
            return let(_buckets(words), lambda b: F.struct(F.size(words).cast("long").alias("n"), *[
                total(b, t).alias(f"s{k}") for k, t in enumerate(tables, 1)]))
        return let(_words(text_col), summed)

    def logits(self, heats: tuple[float, ...] | None = None) -> list[Column]:
        heats = heats or self.heats or (1.0,) * len(self.weights)
        return [F.lit(math.log(self.prior[0]))] + [F.lit(math.log(p)) + F.col(f"s{k}") * F.lit(heats[k - 1] / UNIT) for k, p in enumerate(self.prior[1:], 1)]

    def cell(self) -> dict[str, Column]:
        """Posteriors of all domains but the first in whole steps of 1 / GRID; the steps that rounding down leaves go to the
        domains that lost most by it, so no domain gains from all documents."""
        z = self.logits()
        top = F.greatest(*z)

        def shared(part: Column) -> Column:
            lost = [part[k] - F.floor(part[k]) for k in range(len(z))]
            left = F.lit(GRID) - sum((F.floor(part[k]) for k in range(len(z))), F.lit(0))
            ahead = [sum(((lost[j] > lost[k] if j > k else lost[j] >= lost[k]).cast("int") for j in range(len(z)) if j != k), F.lit(0)) for k in range(len(z))]
            return F.array(*[(F.floor(part[k]) + (ahead[k] < left).cast("int")).cast("int") for k in range(len(z))])

        total = sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
        steps = let(F.array(*[GRID * F.exp(x - top) / total for x in z]), shared)
        return {name: steps[k] for k, name in enumerate(CELL, 1)}


#: Columns that name a cell; there are at most (GRID + domains - 1 choose domains - 1) of them, 20,301 here.
CELL = [f"k_{d}" for d in DOMAINS[1:]]


def posteriors() -> dict[str, Column]:
    """p_<domain> of a row that names its cell; what rounding leaves goes to the first domain."""
    rest = F.lit(GRID) - sum((F.col(k) for k in CELL), F.lit(0))
    return {f"p_{DOMAINS[0]}": (rest / GRID).cast("double")} | {f"p_{d}": (F.col(k) / GRID).cast("double") for d, k in zip(DOMAINS[1:], CELL)}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Classifier:
    """Learn domains from at most about ``max_labelled`` labelled documents, picked by a hash of the id.

    Labels without an id or a usable value are ignored; of repeated labels the
    worst counts. Domains that no document has keep a small prior.
    """
    order = F.create_map(*[x for i, d in enumerate(DOMAINS) for x in (F.lit(d), F.lit(i))])
    usable = labels.select(F.col(id_col).alias("label_id"), order[label_domain()].alias("domain")).where("label_id IS NOT NULL AND domain IS NOT NULL") \
        .groupBy("label_id").agg(F.max("domain").alias("domain")).withColumn("h", F.xxhash64("label_id"))
    share = min(1.0, max_labelled / max(1, usable.count()))
    picked = usable.where(F.pmod(F.shiftright("h", 8), F.lit(1_000_000)) < share * 1_000_000)
    # About max_labelled rows of three numbers: safe to send to every executor.
    known = stage(docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "label_id"), "mix-labelled")
    learn, check = known.where(F.pmod("h", F.lit(5)) != 0), known.where(F.pmod("h", F.lit(5)) == 0)
    seen = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    total = sum(seen.values())
    prior = [(seen.get(i, 0) + 1) / (total + len(DOMAINS)) for i in range(len(DOMAINS))]
    count = [[0] * BUCKETS for _ in DOMAINS]
    rows = learn.select("domain", F.explode(let(_words("text"), _buckets)).alias("bucket")).groupBy("domain", "bucket").count()
    for r in rows.collect():      # at most domains x buckets rows
        count[r["domain"]][r["bucket"]] = r["count"]
    size = {r["domain"]: r["count"] for r in learn.groupBy("domain").count().collect()}

    def weight(k: int, b: int) -> int:
        """Log ratio of the document shares of a bucket in domain k and in the first, 0 if they do not differ clearly."""
        x, nx, y, ny = count[k][b], size.get(k, 0), count[0][b], size.get(0, 0)
        pooled = (x + y + 1) / (nx + ny + 2)
        px, py = (x + 0.5) / (nx + 1), (y + 0.5) / (ny + 1)
        clear = nx and ny and abs(px - py) >= EVIDENT * math.sqrt(pooled * (1 - pooled) * (1 / nx + 1 / ny))
        return round(UNIT * math.log(px / py)) if clear else 0
    model = Classifier(prior, [[weight(k, b) for b in range(BUCKETS)] for k in range(1, len(DOMAINS))])
    # Temperatures: least log-loss on the documents held back.
    grid = list(product((0.01, 0.03, 0.1, 0.2, 0.4, 0.8), repeat=len(DOMAINS) - 1))
    scored = check.select("domain", model.evidence().alias("e")).select("domain", "e.*")

    def loss(heats: tuple[float, ...]) -> Column:
        z = model.logits(heats)
        top = F.greatest(*z)
        mine = sum((F.when(F.col("domain") == k, x).otherwise(0.0) for k, x in enumerate(z)), F.lit(0.0))
        return F.avg(F.round(top + F.log(sum((F.exp(x - top) for x in z), F.lit(0.0))) - mine, 6).cast("decimal(20,6)"))
    losses = list(scored.agg(*[loss(g).alias(f"l{i}") for i, g in enumerate(grid)]).first())
    if losses[0] is not None:
        model.heats = grid[min(range(len(grid)), key=lambda i: losses[i])]
    return model


@dataclass
class Rates:
    """Fitted rates: any document's rate follows from its posterior alone, by the steps of the fit."""

    pull: float
    steps: list[tuple[list[float], float]]       # per step the gradient's factor of each domain's posterior, and the momentum

    def fold(self, p: list[Column]) -> Column:
        """struct(r, y, r0, y0): the rate after all steps and the point of the next gradient, and both before the last step."""
        one = F.lit(1.0)
        start = F.struct(one.alias("r"), one.alias("y"), one.alias("r0"), one.alias("y0"))
        if not self.steps:
            return start
        scale = 1.0 / (1.0 + self.pull)

        def step(state: Column, s: Column) -> Column:
            slope = sum((s[d] * c for d, c in enumerate(p)), self.pull * (state["y"] - 1.0))
            return let(F.greatest(state["y"] - scale * slope, F.lit(0.0)), lambda r: F.struct(
                r.alias("r"), (r + s[len(p)] * (r - state["r"])).alias("y"), state["r"].alias("r0"), state["y"].alias("y0")))
        return F.aggregate(F.array(*[F.array(*[F.lit(float(x)) for x in (*c, m)]) for c, m in self.steps]), start, step)


def fit_rates(cells: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET, pull: float = PULL) -> Rates:
    """Fit rates r >= 0 on ``cells`` (p_<domain>, tokens; staged): least squares of expected domain tokens to their targets.

    Minimises 1/2 (A(r) - t)' M (A(r) - t) + pull/2 * sum_i w_i (r_i - 1)^2, where w_i is the
    cell's share of all tokens, A(r)_d = sum_i w_i r_i p_id and t_d = budget * target share.
    M is the (pseudo-)inverse of sum_i w_i p_i p_i', so no domain counts less for being small
    and the gradient's steepest bend is one. Targets that some rates can meet are met up to the
    pull; of others the nearest in this measure that can is approached.

    Accelerated projected gradient: r' = max(0, y - (p M (A(y) - t) + pull (y - 1)) / (1 + pull)),
    then y goes on past r' by the momentum, which starts anew when it leads uphill. One step is one distributed
    sum over the cells; the steps' few numbers are the only thing the driver keeps, and
    every cell works its rate out of them.
    """
    w = F.col("tokens") / F.lit(float(cells.agg(F.sum("tokens")).first()[0] or 1))
    p = [F.col(f"p_{d}") for d in DOMAINS]
    n, goal = len(p), np.array([budget * targets[d] / sum(targets.values()) for d in DOMAINS])
    found = np.array([x or 0.0 for x in cells.agg(*[F.sum(w * a * b) for a in p for b in p], *[F.sum(w * a) for a in p]).first()])
    metric, now = np.linalg.pinv(found[:n * n].reshape(n, n), rcond=1e-9), found[n * n:]
    steps: list[tuple[list[float], float]] = []
    ahead, theta = now, 1.0
    for _ in range(STEPS):
        factor = [float(x) for x in metric @ (ahead - goal)]
        state = cells.select(w.alias("w"), *p, Rates(pull, [*steps, (factor, 0.0)]).fold(p).alias("s")).select("w", *p, "s.*")
        uphill = F.sum(F.col("w") * (F.col("y0") - F.col("r")) * (F.col("r") - F.col("r0")))
        *totals, up, moved = state.agg(*[F.sum(F.col("w") * F.col("r") * c) for c in p], uphill, F.max(F.abs(F.col("r") - F.col("r0")))).first()
        if moved is None:                         # no cells
            break
        before, now = now, np.array(totals)
        theta = 1.0 if up > 0 else theta
        longer = (1 + math.sqrt(1 + 4 * theta * theta)) / 2
        momentum, theta = (theta - 1) / longer, longer
        steps.append((factor, momentum))
        ahead = now + momentum * (now - before)
        if moved < SETTLED:
            break
    return Rates(pull, steps)


def copies(id_col: str = "doc_id") -> Column:
    """Whole copies with the rate as their mean: the fraction is drawn by a hash of the id."""
    rate = F.col("rate")
    return (F.floor(rate) + F.when(F.pmod(F.xxhash64(id_col, F.lit(8)), F.lit(1 << 20)) / (1 << 20) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _scored(docs: DataFrame, model: Classifier, text_col: str, *keep: Column) -> DataFrame:
    """``keep``, n_tokens (words of the whole text) and the cell of each row; a text without words has the prior's cell."""
    found = docs.select(*keep, model.evidence(text_col).alias("e"))
    found = found.select(*[c for c in found.columns if c != "e"], "e.*")
    return found.withColumns(model.cell()).withColumnRenamed("n", "n_tokens").drop(*[f"s{k}" for k in range(1, len(DOMAINS))])


def _fitted(docs: DataFrame, labels: DataFrame, targets, budget, id_col, text_col) -> tuple[Classifier, DataFrame, DataFrame]:
    """(classifier, rate of every cell, scored documents)."""
    model = train(docs, labels, id_col, text_col)
    member = stage(_scored(docs, model, text_col, F.col(id_col).alias("doc_id")), "mix-members")
    cells = stage(member.groupBy(*CELL).agg(F.sum("n_tokens").alias("tokens")).withColumns(posteriors()), "mix-cells")
    rates = fit_rates(cells, targets, budget)
    # A cell without any tokens changes no total: the rate closest to one is one.
    rate = F.when(F.col("tokens") > 0, F.round(rates.fold([F.col(f"p_{d}") for d in DOMAINS])["r"], 6)).otherwise(1.0)
    return model, stage(cells.select(*CELL, rate.alias("rate")), "mix-rates"), member


def _rated(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``rows`` with the rate of their cell. Every cell has one; the bounded number of cells makes the broadcast safe.

    The left join keeps the scores from being worked out a second time for a filter on the join keys.
    """
    return rows.join(F.broadcast(rates.withColumnRenamed("rate", "cell_rate")), CELL, "left").withColumn("rate", F.coalesce("cell_rate", F.lit(1.0))).drop("cell_rate")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate and copies of every document. Other columns are not read; repeated rows are treated alike."""
    _, rates, member = _fitted(docs, labels, targets, budget, id_col, text_col)
    return _rated(member, rates).withColumns(posteriors()).withColumn("copies", copies()) \
        .select("doc_id", "n_tokens", *[f"p_{d}" for d in DOMAINS], "rate", "copies")


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every row as often as its copies say (none: the row goes); same columns.

    The posterior is evaluated again on each row instead of joined. Rates have no upper bound, so a row goes to
    the shuffle once for every ``COPIES`` of its copies, and is repeated after it: no task makes all copies of one row.
    """
    names = docs.columns
    model, rates, _ = _fitted(docs, labels, targets, budget, id_col, text_col)
    row = _scored(docs, model, text_col, F.struct(*names).alias("row"), F.col(id_col).alias("id"))
    row = _rated(row, rates).select("row", copies("id").alias("copies"))
    part = row.where("copies > 0").select("row", "copies", F.posexplode(F.array_repeat(F.lit(1), F.ceil(F.col("copies") / COPIES).cast("int"))).alias("part", "one"))
    part = part.select("row", F.least(F.col("copies") - F.col("part") * COPIES, F.lit(COPIES)).cast("int").alias("copies")).hint("rebalance")
    return part.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")
