import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiffin.llm import langid, pii, quality
from tiffin.llm.common import table


# ------------------------------------------------------------------ quality rules
def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + k for starts in at.values() if len(starts) > 1 for i in starts for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def brute_mcd(groups):
    """Mean, inverse covariance and median bin per group, step by step in numpy."""
    least = np.diag([(s * quality.STEPS) ** 2 for s in quality.VECTOR.values()])
    out = {}
    for key, x in groups.items():
        x = np.array(x, float)
        h = int(np.ceil(len(x) * quality.COVER))
        order = lambda v, q: np.sort(v)[int(np.ceil(len(v) * q)) - 1]
        sd = np.array([(order(c, 0.75) - order(c, 0.25)) / 1.349 for c in x.T])
        starts = [(np.array([order(c, 0.5) for c in x.T]), np.diag(sd ** 2) + least), (x.mean(0), np.cov(x.T, bias=True) + least)]
        bins = lambda m, c: np.floor(np.log2(np.maximum(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m), 1e-6)) * quality.BINS)
        ends = []
        for m, c in starts:
            for _ in range(quality.CONCENTRATIONS):
                b = bins(m, c)
                near = x[b <= np.sort(b)[h - 1]]
                m, c = near.mean(0), np.cov(near.T, bias=True) + least
            ends.append((np.linalg.slogdet(c)[1], m, c))
        _, m, c = min(ends, key=lambda e: e[0])
        b = bins(m, c)
        out[key] = (m, np.linalg.inv(c), np.sort(b)[int(np.ceil(len(b) * 0.5)) - 1])
    return out


def test_statistics_match_brute_force(spark, nasty):
    rng = random.Random(4)
    vocab = ["a", "bb", "c#", "*", "dd\n", "e\t", "ſ", "ß "]
    rows = [(i, "".join(rng.choice(vocab) + rng.choice([" ", "\n", "", " \r"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(200, "x y z w " * 40), (201, "\n\n a \n a \n\n a "), (202, "one two three four five six seven eight one two three four five six seven eight nine")]
    rows += [(300 + i, r["text"]) for i, r in enumerate(nasty.select("text").collect())]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.statistics(df).collect()}
    assert got == {i: brute_statistics(t) for i, t in rows}


def test_estimates_match_numpy(spark, sf):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = quality.vectors(quality.statistics(docs)).where(~quality.base_failed()).withColumn("source", F.lit("*"))
    vectors = {}
    for r in rows.select("lang", "source", *quality.VECTOR).collect():
        vectors.setdefault((r["lang"], r["source"]), []).append(list(r)[2:])
    vectors = {k: v for k, v in vectors.items() if len(v) >= quality.MIN_GROUP}
    assert vectors
    cells = rows.groupBy("lang", "source", *quality.VECTOR).agg(F.count("*").alias("c"))
    got = {(r["lang"], r["source"]): r for r in quality.robust_estimates(cells).collect()}
    for key, (m, p, half) in brute_mcd(vectors).items():
        assert np.allclose(got[key]["m"], m) and np.allclose(got[key]["p"], p.ravel(), rtol=1e-6, atol=1e-12)
        assert abs(got[key]["half"] - half) <= 1


def test_outliers_go_and_regular_documents_stay(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    regular = [(i, " ".join(word() for _ in range(rng.randint(60, 400)))) for i in range(400)]
    odd = [(1000 + i, " ".join(word() + rng.choice(["###", "***"]) for _ in range(100))) for i in range(10)]
    odd += [(1100 + i, " ".join((word() + word() + word() + word()).upper() for _ in range(100))) for i in range(10)]
    df = spark.createDataFrame([(i, t, "en", None if i % 2 else "s") for i, t in regular + odd], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.judge(df).where("kept").collect()}
    assert kept == {i for i, _ in regular}


def test_repeated_lines_and_passages_can_reject_alone(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    regular = [(i, "\n".join(words(12) for _ in range(rng.randint(5, 30)))) for i in range(400)]
    lines = [(1000 + i, "\n".join(f"{words(12)}\nabcde" for _ in range(15))) for i in range(5)]
    passages = [(1100 + i, " ".join([words(100), p, words(100), p, words(100)])) for i, p in enumerate(words(50) for _ in range(5))]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in regular + lines + passages], "doc_id long, text string, lang string, source string")
    rows = quality.judge(df).collect()
    assert not any(r["base_failed"] for r in rows) and {r["doc_id"] for r in rows if r["kept"]} == {i for i, _ in regular}
    limit = quality.chi_square(quality.D, quality.REJECT_Z)
    assert (np.log(101) / quality.VECTOR["v_lines"]) ** 2 > limit and (np.log(31) / quality.VECTOR["v_repeats"]) ** 2 > limit


def test_quality_edge_cases(nasty, empty):
    rows = quality.judge(nasty).collect()
    assert len(rows) == nasty.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_words"] == by[4]["n_words"] == by[5]["n_words"] == 0 and by[3]["base_failed"] and not by[3]["kept"]
    for r in nasty.collect():
        n_words, _, _, _, n_repeat = brute_statistics(r["text"])
        assert by[r["doc_id"]]["base_failed"] == (n_words < 20 or 100 * n_repeat > 30 * n_words)
    assert all(r["kept"] != r["base_failed"] for r in rows)    # groups are too small for an estimate: the base rule decides
    assert all(r["kept"] is not None and r["base_failed"] is not None for r in rows)
    assert quality.judge(empty).count() == 0


# ------------------------------------------------------------------ personal data
def brute_base(text):
    out = [(m.start(), m.end(), pii.EMAIL) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), pii.IP) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), m.end(), pii.CARD) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), m.end(), pii.PHONE) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def luhn(d):
    return (sum(int(c) for c in d[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in d[-2::-2])) % 10 == 0


def test_base_spans_match_the_patterns():
    rng = random.Random(6)
    parts = ["a@b.c", "x.y+z@", "@", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 555-6789", "+44", ".", "-", " ", "12", "é", "(", ")", "b.co", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == brute_base(text), repr(text)
    assert pii.base_spans(None) == pii.base_spans("") == []
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1 " * 50_000, "1." * 100_000):   # linear on long runs
        pii.base_spans(text)


def brute_decode(model, text, segments):
    best = (0.0, [])

    def go(chosen, start, last, score):
        nonlocal best
        if score > best[0] + 1e-12:
            best = (score, list(chosen))
        for s in segments:
            if s[0] >= start:
                go(chosen + [s], s[1], s[2], score + model.step(last, s[2]) + model.score(text, s))
    go([], 0, 4, 0.0)
    return best


def test_decoding_matches_all_choices():
    rng = random.Random(8)
    for _ in range(60):
        segments = list({(s, s + rng.randint(1, 5), rng.randrange(4)) for s in [rng.randrange(12) for _ in range(6)]})
        segments.sort(key=lambda s: (s[1], s[0], s[2]))
        scores = {s: rng.uniform(-2, 2) for s in segments}
        model = pii.SemiCRF({f"{a}>{b}": rng.uniform(-1, 1) for a in range(5) for b in range(4)})
        model.score = lambda text, s: scores[s]
        got = model.decode("", segments)
        total, last = 0.0, 4
        for s in got:
            total, last = total + model.step(last, s[2]) + scores[s], s[2]
        assert total == pytest.approx(brute_decode(model, "", segments)[0])


def windows():
    rng = random.Random(3)
    out = []
    for i in range(150):
        d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        card = next(c for c in (d(16) for _ in range(1000)) if luhn(c))
        pick = rng.choice([f"joe.{d(2)}@mail{d(1)}.example.com", f"{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}",
                           f"+1 ({d(3)}) 555-{d(4)}", card, d(16), d(7), f"{d(4)}-{d(2)}-{d(2)}", f"version {d(1)}.{d(1)}.{d(2)}"])
        out.append(f"some words here {pick} and more of them")
    return out


def test_model_adds_rewritten_spans_and_leaves_numbers_alone():
    model = pii.SemiCRF()
    model.learn(pii.examples_from(windows()))
    for text, kind in [("call (212) 555-0188 now please", pii.PHONE), ("write joe.12 [at] mail3 [dot] example [dot] com soon", pii.EMAIL),
                       ("server 10[.]20[.]30[.]40 is down", pii.IP)]:
        base, spans = pii.all_spans(text, model)
        assert not base and [s[2] for s in spans] == [kind], text
    for text in ("in 1998 and 2004 there were 1234567 of them", "no numbers at home. Then dots.", "order 1234567890123456 of 2020-01-02"):
        assert pii.all_spans(text, model)[1] == [], text
    assert pii.redacted("mail a@b.com or +1 (234) 555-6789!", model) == "mail <EMAIL> or <PHONE>!"


def test_personal_data_query(spark, sf):
    from tiffin.llm.queries import QUERIES
    text = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = QUERIES["op5_personal_data"](spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(text)
    for r in rows:
        base = brute_base(text[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(pii.digest(base).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[2] == k for s in base) for k in range(4)]
        assert not Counter(filter(None, pii.digest(base).split(","))) - Counter(r["spans"].split(","))


def test_personal_data_edge_cases(nasty, empty):
    model = pii.train(nasty)
    rows = pii.find(nasty, model).collect()
    assert len(rows) == nasty.count() and all(r["base_sha256"] for r in rows)
    assert {r["spans"] for r in rows if r["doc_id"] in (3, 4, 5)} == {""}
    clean = pii.redact(nasty, model)
    assert clean.columns == nasty.columns and clean.where("doc_id = 3 AND text IS NULL").count() == 1
    assert pii.find(empty, pii.train(empty)).count() == 0 and pii.redact(empty, pii.SemiCRF()).count() == 0


# ------------------------------------------------------------------ language ID
def test_filter_returns_every_language_of_a_gram():
    rng = np.random.default_rng(0)
    gram = rng.integers(-1 << 62, 1 << 62, 3000)
    language = rng.integers(0, 11, 3000)                    # two bytes of masks
    f = langid.BitSlicedFilter.build([f"l{i:02}" for i in range(11)], gram, language)
    for k in range(11):
        mine = gram[language == k].view(np.uint64)
        assert f.hits(mine)[k] == len(mine)                 # no false negatives
    other = rng.integers(-1 << 62, 1 << 62, 20_000).view(np.uint64)
    assert np.abs(f.hits(other) / 20_000 - f.false_rate).max() < 0.01


def brute_grams(text):
    padded = [None] + [c if c.isalpha() else None for c in text.lower()] + [None]
    return Counter(tuple(padded[i:i + n]) for n in langid.ORDERS for i in range(len(padded) - n + 1) if all(padded[i + 1:i + n - 1]))


def test_grams_match_brute_force(monkeypatch):
    rng = random.Random(2)
    for piece in (1 << 20, 7):
        monkeypatch.setattr(langid, "PIECE", piece)
        for _ in range(100):
            text = "".join(rng.choice("abÉß ,1\n漢") for _ in range(rng.randint(0, 40)))
            got = np.concatenate([g for g in langid.grams(text)] or [np.empty(0, np.uint64)])
            assert sorted(Counter(got.tolist()).values()) == sorted(brute_grams(text).values())


def test_held_out_accuracy(spark):
    from tiffin.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op10_language"](spark, sf).collect()
    lang = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    assert {r["doc_id"] for r in rows} == set(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(held) / len(held) >= 0.98


def test_language_edge_cases(nasty, empty):
    model = langid.train(langid.learnable(nasty))
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.identify(nasty, model).collect()}
    assert got[3, "und"] == got[4, "und"] == got[5, "und"] == got[8, "und"] == 0.0
    assert all(lang in ("en", "fr", "de", "und") for _, lang in got)
    none = langid.train(langid.learnable(empty))
    assert langid.identify(empty, none).count() == 0 and none.predict("text") == ("und", 0.0)


# ------------------------------------------------------------------ past former limits
def test_long_addresses_are_candidates_as_a_whole():
    local, host = "x" * 90, ".".join(f"part{k}" for k in range(30))
    text = f"mail {local} [at] mail3 [dot] com soon, or {local}(at){host} or a@b@c.d"
    spans = {text[s:e] for s, e, k in pii.candidates(text) if k == pii.EMAIL}
    assert f"{local} [at] mail3 [dot] com" in spans and f"{local}(at){host}" in spans
    assert all(x.startswith(local) or x in ("b@c.d",) for x in spans)


def test_regions_of_any_length_are_learned_from():
    text = "call " + " ".join(f"555 010 {k:04d}" for k in range(200)) + " now"
    windows = list(pii._windows(text))
    assert windows and max(map(len, windows)) < 1000
    found = {text[s:e] for s, e, _ in pii.candidates(text)}
    seen = {w[s:e] for w in windows for s, e, _ in pii.candidates(w)}
    assert {x for x in found if len(x) <= 12} <= seen
    word = "y" * 1000 + "@" + "z" * 500 + ".com"
    assert list(pii._windows(f"to {word} it")) == [word]


def test_each_language_keeps_its_part_of_the_filter(spark):
    from tiffin.llm import langid
    rows = [(i, "alpha beta gamma delta words here " * 3 + f"w{i}", "big") for i in range(400)] + [(1000, "zzyzx qwrty plugh", "small"), (1001, "ünïcöde ßtraße", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, max_grams=120)                     # far fewer than the n-grams of the large language
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert got[1000] == "small" and got[1001] == "tiny" and got[3] == "big"
