"""Personal data: pattern matches, and a semi-Markov CRF that adds spans the patterns miss.

The patterns (e-mail, IP, card, phone) give base spans, which always stay. The
semi-CRF scores whole candidate segments (digit groups, separators, checksums,
neighbouring words) and a dynamic programme over segment ends chooses boundaries
and types together; a host is tried at each of its first ``MAX_GROUPS`` parts and as a whole. It is trained
on a bounded sample of text windows: base spans are the labels, rewritten forms
of them (a phone without country code, ``name [at] host [dot] com``) are added as
further examples, and numbers that fail the checks are counter-examples.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: The base patterns, written so that no run of characters is tried twice.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")

#: Ends of a host that are tried, its whole besides; the reach of a region of candidates; characters of a window for training.
MAX_GROUPS, GAP, WINDOW = 8, 40, 400
#: Bounds of the training sample: documents scanned for windows, and windows of each sort learned from.
SAMPLE_DOCS, SAMPLE_WINDOWS = 40_000, 400
EPOCHS, RATE, SHRINK = 6, 0.2, 1e-4

_RUN = re.compile(r"[+(]?[0-9](?:[ ().\-/\[\]]{0,3}[0-9])+")
_GROUP = re.compile("[0-9]+")
_AT = re.compile(r" ?(?:\(at\)|\[at\]) ?| at |@| @ ")
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}")
_DOT = re.compile(r" ?(?:\(dot\)|\[dot\]) ?| dot |\.")

Span = tuple[int, int, int]   # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[Span]:
    floor, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        if m:
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            floor = m.end()
            yield start, floor, EMAIL
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[Span]:
    """Pattern matches of a whole text, by start, then kind; matches that fail their check are dropped."""
    if not text:
        return []
    found = list(_emails(text))
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), IP) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                found.append((m.start(), m.end(), CARD))
        if "+" in text:
            found += [(m.start(), m.end(), PHONE) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


# ------------------------------------------------------------------ candidates and whole-span features
def candidates(text: str) -> list[Span]:
    """Segments that could be personal data, with every admissible type and boundary; by end."""
    out: set[Span] = set()
    if _DIGIT.search(text):
        for run in _RUN.finditer(text):
            if run.end() - run.start() < 7:
                continue
            groups = [m.span() for m in _GROUP.finditer(text, run.start(), run.end())]
            for i in range(len(groups)):
                digits = 0
                for j in range(i, len(groups)):
                    digits += groups[j][1] - groups[j][0]
                    if digits > 19:
                        break
                    start, end = groups[i][0], groups[j][1]
                    while start > run.start() and text[start - 1] in "+(":
                        start -= 1
                    if 7 <= digits <= 15:
                        out.add((start, end, PHONE))
                    if 14 <= digits:
                        out.add((groups[i][0], end, CARD))
                    if j - i == 3 and digits <= 12 and "." in text[start:end]:
                        out.add((groups[i][0], end, IP))
    if "@" not in text and "(at)" not in text and "[at]" not in text and not (" at " in text and " dot " in text):
        return sorted(out, key=lambda s: (s[1], s[0], s[2]))
    for at in _AT.finditer(text):
        start = at.start()
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at.end())
        if start == at.start() or not host:
            continue
        end, parts = host.end(), 0
        while True:
            dot = _DOT.match(text, end)
            if dot and at[0] == " at " and dot[0] == ".":   # plain prose: "at" and a full stop
                break
            host = dot and _HOST.match(text, dot.end())
            if not host:
                break
            end, parts = host.end(), parts + 1
            if parts <= MAX_GROUPS:
                out.add((start, end, EMAIL))
        if parts > MAX_GROUPS:                              # of a longer host, the whole besides
            out.add((start, end, EMAIL))
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


_WORD_BEFORE = re.compile(r"([^\W\d_]{1,20})[ :=.#]{0,3}$")


def features(text: str, span: Span) -> list[str]:
    """Features of the whole segment and what touches it."""
    start, end, kind = span
    s, k = text[start:end], KINDS[span[2]]
    before, after = text[start - 1:start], text[end:end + 1]
    word = _WORD_BEFORE.search(text, max(0, start - 24), start)
    out = [k, f"{k} before {_sort(before)}", f"{k} after {_sort(after)}", f"{k} word {word[1].lower() if word else ''}"]
    if kind == EMAIL:
        at = _AT.search(s)[0].strip()
        labels = _DOT.split(s[_AT.search(s).end():])
        dots = {x.strip() for x in _DOT.findall(s[_AT.search(s).end():])}
        out += [f"{k} at {at}", f"{k} dots {sorted(dots)}", f"{k} marks {at} {sorted(dots)}", f"{k} tail {min(len(labels[-1]), 5)}",
                f"{k} letters {labels[-1].isalpha()}", f"{k} more {bool(_DOT.match(text, end))}"]
    else:
        groups = _GROUP.findall(s)
        digits, marks = "".join(groups), "".join(sorted(set(_GROUP.sub("", s))))
        out += [f"{k} digits {len(digits)}", f"{k} shape {'-'.join(str(len(g)) for g in groups)}", f"{k} marks {marks}",
                f"{k} first {s[0] if s[0] in '+(' else '0'}", f"{k} plain {len(groups) == 1}", f"{k} paired {s.count('(') == s.count(')')}"]
        if kind == IP:
            out += [f"{k} small {all(map(_small, groups))}", f"{k} even {len(set(_GROUP.split(s)[1:-1])) == 1}"]
        if kind == CARD:
            out += [f"{k} luhn {luhn(digits)}", f"{k} luhn {luhn(digits)} marks {marks}"]
    return out


def _sort(c: str) -> str:
    return "edge" if not c else "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else c


# ------------------------------------------------------------------ model
@dataclass
class SemiCRF:
    """Log-linear weights of segment features and of one entity type following another in a region."""

    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str, span: Span) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(text, span))

    def step(self, last: int, kind: int) -> float:
        return self.weights.get(f"{last}>{kind}", 0.0)

    def decode(self, text: str, segments: list[Span], scores: list[float] | None = None) -> list[Span]:
        """Best choice of disjoint segments: bounded-entity Viterbi over segment ends and types.

        Text outside the chosen segments scores 0. Of equal choices the one found first stays.
        """
        if not segments:
            return []
        scores = scores or [self.score(text, s) for s in segments]
        points = sorted({p for s in segments for p in s[:2]})
        ending = defaultdict(list)
        for n, s in enumerate(segments):
            ending[s[1]].append(n)
        # best[point][last type, 4 = none]: (score, (segment, type before it, point before it) or None)
        best: dict[int, list[tuple[float, tuple | None]]] = {}
        state = [(-math.inf, None)] * 4 + [(0.0, None)]
        for p in points:
            state = list(state)
            for n in ending[p]:
                start, _, kind = segments[n]
                for last, (value, _) in enumerate(best[start]):
                    v = value + self.step(last, kind) + scores[n]
                    if v > state[kind][0]:
                        state[kind] = (v, (n, last, start))
            best[p] = state
        last = max(range(5), key=lambda y: (state[y][0], y))
        chosen, point = [], points[-1]
        while (link := best[point][last][1]) is not None:
            n, last, point = link
            chosen.append(segments[n])
        return chosen[::-1]

    def learn(self, examples: list[tuple[str, list[Span]]]) -> None:
        """Stochastic gradient on the conditional log-likelihood; expectations by forward-backward over the segment lattice."""
        prepared = []
        for text, gold in examples:
            segments = sorted(set(candidates(text)) | set(gold), key=lambda s: (s[1], s[0], s[2]))
            if segments:
                prepared.append((segments, [features(text, s) for s in segments], sorted(gold)))
        order = random.Random(7)
        for _ in range(EPOCHS):
            order.shuffle(prepared)
            for segments, feats, gold in prepared:
                self._update(segments, feats, gold)

    def _update(self, segments, feats, gold) -> None:
        w = self.weights
        scores = [sum(w.get(f, 0.0) for f in fs) for fs in feats]
        points = sorted({p for s in segments for p in s[:2]})
        at = {p: i for i, p in enumerate(points)}
        none = -math.inf
        fore = [[none] * 5 for _ in points]
        by_end, by_start = defaultdict(list), defaultdict(list)
        for n, s in enumerate(segments):
            by_end[at[s[1]]].append(n)
            by_start[at[s[0]]].append(n)
        for i in range(len(points)):
            fore[i] = list(fore[i - 1]) if i else [none] * 4 + [0.0]
            for n in by_end[i]:
                a, kind = at[segments[n][0]], segments[n][2]
                fore[i][kind] = _logsum([fore[i][kind]] + [fore[a][y] + self.step(y, kind) + scores[n] for y in range(5)])
        back = [[0.0] * 5 for _ in points]
        for i in range(len(points) - 2, -1, -1):
            for y in range(5):
                back[i][y] = _logsum([back[i + 1][y]] + [self.step(y, segments[n][2]) + scores[n] + back[at[segments[n][1]]][segments[n][2]] for n in by_start[i]])
        whole = _logsum(fore[-1])
        change: dict[str, float] = defaultdict(float)
        for n, (start, end, kind) in enumerate(segments):
            expected = 0.0
            for y in range(5):
                v = fore[at[start]][y] + self.step(y, kind) + scores[n] + back[at[end]][kind] - whole
                if v > -30:
                    p = math.exp(v)
                    expected += p
                    change[f"{y}>{kind}"] -= p
            if expected > 1e-9:
                for f in feats[n]:
                    change[f] -= expected
        last = 4
        index = {s: n for n, s in enumerate(segments)}
        for s in gold:
            change[f"{last}>{s[2]}"] += 1
            last = s[2]
            for f in feats[index[s]]:
                change[f] += 1
        for f, g in change.items():
            w[f] = w.get(f, 0.0) * (1 - SHRINK) + RATE * g


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


# ------------------------------------------------------------------ training
def _disjoint(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def _windows(text: str | None) -> Iterator[str]:
    """Text around each region of candidates or base spans, cut at spaces; a region beyond ``WINDOW`` goes on in the next."""
    if not text:
        return
    marks = sorted([s[:2] for s in base_spans(text)] + [s[:2] for s in candidates(text)])
    i = 0
    while i < len(marks):
        start, end = marks[i]
        while i < len(marks) and marks[i][0] <= min(end + GAP, start + WINDOW):
            end = max(end, marks[i][1])
            i += 1
        left = text.rfind(" ", max(0, start - GAP), start)
        right = text.find(" ", end, end + GAP)
        yield text[left + 1 if left >= 0 else start:right if right >= 0 else end]


def _rewritten(text: str, span: Span, rng: random.Random) -> tuple[str, Span] | None:
    """The window with the span in a form that no base pattern takes."""
    s, kind = text[span[0]:span[1]], span[2]
    groups = _GROUP.findall(s)
    if kind == EMAIL:
        local, host = s.split("@")
        at, dot = rng.choice([(" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", ".")])
        new = local + at + host.replace(".", dot)
    elif kind == IP:
        new = rng.choice(["[.]", " . "]).join(groups)
    elif kind == CARD:
        d = "".join(groups)
        new = rng.choice([".", "/", " - "]).join(d[i:i + 4] for i in range(0, len(d), 4))
    else:
        d = "".join(groups)[-10:]
        new = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}){}-{}"]).format(d[:3], d[3:6], d[6:])
    return text[:span[0]] + new + text[span[1]:], (span[0], span[0] + len(new), kind)


def _spoiled(text: str, span: Span, rng: random.Random) -> str | None:
    """The window with a number that only looks like the span: it fails the check of its kind."""
    s, kind = text[span[0]:span[1]], span[2]
    if kind == CARD:
        i = rng.choice([m.start() for m in _DIGIT.finditer(s)])
        new = s[:i] + str((int(s[i]) + rng.randint(1, 4)) % 10) + s[i + 1:]
        return None if luhn(_NOT_DIGIT.sub("", new)) else text[:span[0]] + new + text[span[1]:]
    if kind == IP:
        groups = s.split(".")
        groups[rng.randrange(4)] = str(rng.randint(256, 999))
        return text[:span[0]] + rng.choice([".", "[.]"]).join(groups) + text[span[1]:]
    if kind == PHONE:
        d = _NOT_DIGIT.sub("", s)
        return text[:span[0]] + rng.choice([d, f"{d[:4]}-{d[4:6]}-{d[6:8]}", f"{d[:2]}.{d[2:4]}.{d[4:8]}"]) + text[span[1]:]
    return None


def examples_from(windows: list[str], seed: int = 11) -> list[tuple[str, list[Span]]]:
    rng = random.Random(seed)
    out = []
    for text in windows:
        gold = _disjoint(base_spans(text))
        out.append((text, gold))
        if len(gold) == 1:
            new, span = _rewritten(text, gold[0], rng)
            out.append((new, [span]))
            bad = _spoiled(text, gold[0], rng)
            if bad is not None:
                out.append((bad, _disjoint(base_spans(bad))))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> SemiCRF:
    """Fit on windows of at most about ``sample_docs`` documents (picked by a hash of id and text).

    At most ``sample_windows`` windows with a base span and as many without reach
    the driver. Without any, the model is empty and adds nothing.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = rows.count()
    share = min(1.0, sample_docs / max(1, n))

    def run(batches):
        for b in batches:
            found = [w for t in b.column(0).to_pylist() for w in _windows(t)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([bool(base_spans(w)) for w in found], pa.bool_())], names=["w", "has"])

    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select("text")
    found = picked.mapInArrow(run, "w string, has boolean").distinct()
    from .common import stage
    found = stage(found, "pii-windows")
    windows = [r["w"] for has in (True, False) for r in
               found.where(F.col("has") == has).select("w", F.xxhash64("w").alias("h")).orderBy("h", "w").limit(sample_windows).collect()]
    model = SemiCRF()
    model.learn(examples_from(windows))
    return model


# ------------------------------------------------------------------ operator
def added_spans(text: str | None, base: list[Span], model: SemiCRF) -> list[Span]:
    """Segments the model adds: it decodes what base spans leave free, region by region."""
    if not text or not model.weights:
        return []
    taken, free = sorted(s[:2] for s in base), []
    i = 0
    for c in sorted(candidates(text)):
        while i < len(taken) and taken[i][1] <= c[0]:
            i += 1
        if i == len(taken) or c[1] <= taken[i][0]:
            free.append(c)
    out: list[Span] = []
    region: list[Span] = []
    end = -1
    for c in free + [(1 << 62, 1 << 62, 0)]:
        if region and c[0] > end + GAP:
            out += model.decode(text, sorted(region, key=lambda s: (s[1], s[0], s[2])))
            region = []
        region.append(c)
        end = max(end, c[1]) if len(region) > 1 else c[1]
    return out


def all_spans(text: str | None, model: SemiCRF) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind."""
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, model), key=lambda s: (s[0], s[2], s[1]))


def digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame, model: SemiCRF, text_col: str = "text") -> DataFrame:
    """``docs`` with columns base and spans: strings ``kind:start:end``, comma-joined, and base counts per kind.

    Offsets are code points, ends exclusive, of the whole text. Null and empty
    texts have no spans. All input columns pass through, except ones named like the new columns.
    """
    new = ["n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            cols = [[] for _ in new]
            for text in b.column(at).to_pylist():
                base, spans = all_spans(text, shared.value)
                for k in range(4):
                    cols[k].append(sum(s[2] == k for s in base))
                cols[4].append(len(spans) - len(base))
                cols[5].append(hashlib.sha256(digest(base).encode()).hexdigest())
                cols[6].append(digest(spans))
            yield pa.RecordBatch.from_arrays(b.columns + [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.string()) for c in cols[5:]],
                                             names=b.schema.names + new)

    types = [T.LongType()] * 5 + [T.StringType()] * 2
    return docs.mapInArrow(run, T.StructType(docs.schema.fields + [T.StructField(n, t) for n, t in zip(new, types)]))


def redacted(text: str | None, model: SemiCRF) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    if not text:
        return text
    out, at = [], 0
    for s, e, k in all_spans(text, model)[1]:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, model: SemiCRF, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; ``length_col`` follows the new text."""
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            new = pa.array([redacted(t, shared.value) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    out = docs.mapInArrow(run, schema)
    if length_col in names:
        kind = schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(kind)).select(*names)
    return out
