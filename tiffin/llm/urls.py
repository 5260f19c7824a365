"""URL filter: rules by host and path, then word segmentation of hosts and naive Bayes over the tokens.

URLs that a rule covers train the classifier; it judges the others. Hosts are
cut at dots, hyphens and digits, and each remaining run of letters is split into
words by unigram Viterbi. Words and their counts come from the texts of a table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

#: (host, path, verdict). A rule fits its host and all subdomains if the path starts with the rule's; longest wins.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Longest word of a host: a label of a domain name has at most 63 characters.
MAX_WORD = 63
#: Steps per unit of log-probability: sums of tokens are exact integers.
UNIT = 1_000_000


# ------------------------------------------------------------------ parts and rules
def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


# ------------------------------------------------------------------ words of a host
@dataclass
class Unigrams:
    """Log-probabilities of words; unknown runs cost more with every letter."""

    cost: dict[str, float]
    unknown: float          # per letter of a run that is no word

    @classmethod
    def of(cls, counts: dict[str, int], words: int | None = None) -> "Unigrams":
        """From word counts; ``words``: the number of words in all, if ``counts`` holds only those of interest."""
        total = (sum(counts.values()) if words is None else words) + 1
        return cls({w: math.log(total / n) for w, n in counts.items()}, math.log(total) + math.log(26))

    def split(self, run: str) -> list[str]:
        """Words of least total cost; of equal costs the split with the longer last word."""
        best, back = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            for start in range(max(0, end - MAX_WORD), end):
                word = run[start:end]
                c = best[start] + self.cost.get(word, self.unknown * len(word))
                if c < best[end]:
                    best[end], back[end] = c, start
        out, end = [], len(run)
        while end:
            out.append(run[back[end]:end])
            end = back[end]
        return out[::-1]


_RUN = re.compile(r"[^\W\d_]+|\d+")


def _label_runs(host: str | None) -> list[str]:
    """Runs of letters and of digits of all labels but the last."""
    return [run for label in (host or "").split(".")[:-1] for run in _RUN.findall(label)]


def host_tokens(host: str | None, words: Unigrams) -> list[str]:
    """h:<word> per word of the host, t:<its last label>, numbers as their length."""
    out = []
    for run in _label_runs(host):
        out += [f"h:{w}" for w in words.split(run)] if not run[0].isdigit() else [f"h:#{len(run)}"]
    last = (host or "").split(".")[-1]
    return out + [f"t:{last}"] if last else out


def path_tokens(path: str | None) -> list[str]:
    """p:<word> per word of the path, numbers as their length."""
    return [f"p:{r.lower()}" if not r[0].isdigit() else f"p:#{len(r)}" for r in _RUN.findall(path or "")]


def tokens(host: str | None, path: str | None, words: Unigrams) -> list[str]:
    return host_tokens(host, words) + path_tokens(path)


def count_words(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all words (runs of letters, lower case) of all texts."""
    word = re.compile(r"[^\W\d_]+")

    def run(batches):
        held: Counter = Counter()

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    held.update(word.findall(t.lower()))
                if len(held) > 200_000:       # summed again after the shuffle
                    yield emit()
                    held.clear()
        yield emit()

    return texts.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _substrings(batches):
    """(host, part) for every substring of a letter run of the host that could be a word, at least once each."""
    parts: set[tuple[str, str]] = set()

    def emit():
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string())], names=["host", "part"])
    for b in batches:
        for host in b.column(0).to_pylist():
            for run in _label_runs(host):
                if run[0].isdigit():
                    continue
                for start in range(len(run)):
                    parts.update((host, run[start:end]) for end in range(start + 1, min(len(run), start + MAX_WORD) + 1))
                    if len(parts) > 100_000:
                        yield emit()
                        parts.clear()
    yield emit()


def split_hosts(hosts: DataFrame, texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(host, host_tokens) per row of ``hosts`` (host, distinct), by the counts of all words of all texts.

    Only words that stand in some host are of use, so the counts of all words meet the distinct substrings of the
    hosts, and each host gets those of its own; nothing is cut by frequency and no vocabulary is sent around.
    """
    counts = stage(count_words(texts, text_col), "url-words")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = hosts.mapInArrow(_substrings, "host string, part string")
    useful = parts.select("part").distinct()
    useful = stage(counts.join(useful, F.col("word") == F.col("part"), "left_semi"), "url-host-words")
    own = parts.join(useful, F.col("part") == F.col("word")).groupBy("host").agg(F.collect_set(F.struct("word", "n")).alias("words"))

    def split(batches):
        for b in batches:
            out = []
            for host, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.append(host_tokens(host, Unigrams.of({k["word"]: k["n"] for k in known or ()}, total)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["host", "host_tokens"])

    return hosts.join(own, "host", "left").select("host", "words").mapInArrow(split, "host string, host_tokens array<string>")


# ------------------------------------------------------------------ operator
def judge(urls: DataFrame, texts: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "text",
          rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the classifier's log-odds of block where no rule fits, per row of ``urls``.

    A null url and one without ``://`` have empty host and path, no tokens, and
    the verdict of the class priors. Equal odds allow. Without URLs of both
    classes under rules, everything else is allowed. Distinct (host, path) pairs
    are tokenised and scored once, so a host of many repeats costs no more.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    pages = urls.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))

    @F.pandas_udf("array<string>")
    def of_path(paths: pd.Series) -> pd.Series:
        return paths.map(path_tokens)

    pairs = stage(pages.groupBy("host", "path").agg(F.count("*").alias("n")), "url-paths")
    hosts = stage(split_hosts(pairs.select("host").distinct(), texts, text_col), "url-hosts")
    pairs = stage(pairs.join(hosts, "host").withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
                  .select("host", "path", "n", F.concat("host_tokens", of_path("path")).alias("tokens"), "r.rule", "r.verdict"), "url-pairs")
    block = F.col("verdict") == "block"
    known = pairs.where("verdict IS NOT NULL")
    totals = known.agg(F.sum(F.when(block, F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(block, 0).otherwise(F.col("n"))).alias("a")).first()
    nb, na = totals["b"] or 0, totals["a"] or 0
    counts = known.select(F.explode("tokens").alias("token"), "verdict", "n").groupBy("token").agg(
        F.sum(F.when(block, F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(block, 0).otherwise(F.col("n"))).alias("a"))
    counts = stage(counts, "url-tokens")
    size = counts.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("v")).first()
    tb, ta, v = size["b"] or 0, size["a"] or 0, size["v"] + 1
    odds = lambda b, a: F.round(UNIT * F.log(((b + 1) / F.lit(float(tb + v))) / ((a + 1) / F.lit(float(ta + v))))).cast("long")
    weights = counts.select("token", odds(F.col("b"), F.col("a")).alias("odds"))
    prior = round(UNIT * math.log(nb / na)) if nb and na else None
    unseen = round(UNIT * math.log((ta + v) / (tb + v)))     # a token that no rule's URL has

    open_ = pairs.where("verdict IS NULL").select("host", "path", F.explode_outer("tokens").alias("token"))
    scored = open_.join(weights, "token", "left").groupBy("host", "path") \
        .agg(F.sum(F.when(F.col("token").isNull(), 0).otherwise(F.coalesce("odds", F.lit(unseen)))).alias("odds"))
    odds_of = stage(scored.select("host", "path", ((F.col("odds") + (prior or 0)) / UNIT).alias("log_odds")), "url-odds")
    out = pages.join(odds_of, ["host", "path"], "left").withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    blocked = F.col("log_odds") > 0 if prior is not None else F.lit(False)
    return out.select("page_id", "host", "path", "r.rule", F.coalesce("r.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
                      F.when(F.col("r").isNull(), F.col("log_odds")).alias("log_odds"))
