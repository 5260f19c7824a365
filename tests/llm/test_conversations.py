import hashlib
import random
import re
import zlib

from tiffin.llm import conversations as cv
from tiffin.llm.common import table

INITIAL = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
NOTHING = hashlib.sha256(b"").hexdigest()


def cheapest(s):
    """(cost, audit) by trying every edit at every row and state."""
    best = {}
    for k in range(len(s), -1, -1):
        raw = {}
        for state in range(4):
            out = [(0, "")] if k == len(s) and state in (0, 3) else []
            if k < len(s):
                nxt, c, extra = best[k + 1], s[k].lower(), 5 if s[k].isupper() else 0
                out.append((nxt[state][0] + 2, "D" + nxt[state][1]))
                for name, cost, role in (("K", 0, c), ("R", 1, "a" if state == 2 else "u")):
                    to = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(role)
                    if c != "x" and to is not None:
                        out.append((nxt[to][0] + cost + extra, name + nxt[to][1]))
            raw[state] = min(out) if out else (10 ** 9, "")
        for _ in range(2):                            # up to two inserts
            raw = {st: min(raw[st], (raw[3 if st == 2 else 2][0] + 5, "I" + raw[3 if st == 2 else 2][1])) for st in range(4)}
        best[k] = raw
    return best[0][0]


def test_products_of_rules_equal_plain_search():
    rng = random.Random(0)
    for _ in range(2000):
        s = "".join(rng.choice("suaoSUAOx" if rng.random() < .5 else "uuuaaaxsU") for _ in range(rng.randint(0, 16)))
        rules, known = [], "suaoSUAOx"
        for k in range(rng.randint(0, 6)):
            rules.append((chr(0xE000 + k), rng.choice(known) + rng.choice(known)))
            known += rules[-1][0]
        cost, audit = cv.repair(s, rules, cv.matrices(rules))
        assert (cost, audit) == cheapest(s), s
        lines, _ = cv.carry_out(audit, [INITIAL.get(c.lower(), "user") for c in s], list(s))
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))


def brute(rows):
    """Results by conversation from (conv_id, turn, role, text), damage included."""
    by_conv = {}
    for conv, turn, role, text in rows:
        mine = by_conv.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(key.encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        mine += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    out = {}
    for conv, mine in by_conv.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, s, n = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else ""
            seen.add((role, text))
            c = role[:1] if role[:1] in tuple("sua") else "o"
            s += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
            if fault:
                n[fault] += 1
        turns = [t for t, _, _ in mine if t is not None]
        initials = [r[:1] for _, r, _ in mine]
        cost, audit = cheapest(s)
        lines, _ = cv.carry_out(audit, [r for _, r, _ in mine], [t for _, _, t in mine])
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SHAPE = "conv_id long, turn long, role string, text string, harm string, m string, k int, copies string, part int"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "h", "m", 1, "c", 2) for r in rows], SHAPE)


def got(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_matches_brute_force(spark, sf):
    from tiffin.llm.queries import QUERIES
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op12_conversation_repair"](spark, sf)) == brute(rows)


def test_long_conversations_over_many_blocks_and_odd_rows(spark):
    rng = random.Random(4)
    say = ["Yes.", "No!", "Why?", "cut off", "  ", "", None, "Ünï.", "line\nbreak.", "end. \n"]
    rows = [(7, t, rng.choice(["user", "assistant", "user", "assistant", "tool", None]), f"{rng.choice(say)} {t % 900}." if t % 3 else rng.choice(say))
            for t in range(2600)]
    rows += [(8, t // 3, rng.choice(["user", "assistant"]), "same.") for t in range(1500)]           # ties, copies
    rows += [(9, 5, "user", "copy.")] * 1300                                                         # one row, over and over
    rows += [(None, None, None, None), (None, 3, "user", "Hi."), (None, 4, "", "Empty role."), (10, None, "system", "S."), (10, 1, "user", "U"),
             (11, 2, "assistant", None), (12, -5, "s", "Odd role."), (13, 1, "user", "x" * 300_000 + "."), (13, 2, "assistant", "y" * 900_000)]
    rows += [(i, t, r, "Fine.") for i in range(100, 160) for t, r in enumerate(("system", "user", "assistant"))]
    rng.shuffle(rows)
    want = brute(rows)
    assert got(cv.repair_conversations(cv.damaged(rows_of(spark, rows).repartition(5)))) == want


def test_empty_table_and_all_rows_dropped(spark):
    assert cv.repair_conversations(cv.damaged(rows_of(spark, []))).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert got(cv.repair_conversations(cv.damaged(rows_of(spark, [(gone, 0, "user", "Hi.")])))) == {gone: (0, 0, 0, 0, 0, 0, "", NOTHING)}


def test_rows_as_they_are_and_repaired_rows(spark):
    rows = rows_of(spark, [(1, 0, "user", "Hi."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Alone.")])
    r = {x["conv_id"]: x for x in cv.repair_conversations(cv.as_they_are(rows), with_rows=True).collect()}
    assert r[1]["audit"] == "DKK" and r[1]["repaired"] == ["user:Hello?", "assistant:Yes."] and r[1]["cost"] == 2
    assert r[2]["audit"] == "D" and r[2]["repaired"] == [] and r[2]["repaired_sha256"] == NOTHING


def test_grammar_takes_the_most_frequent_pairs(spark):
    rules = cv.grammar(spark.createDataFrame([("uaua",)] * 5 + [("suaua",)] * 3 + [("xx",)], "s string"))
    assert rules[0][1] == "ua" and any(p == rules[0][0] * 2 for _, p in rules)
    back = {name: pair for name, pair in rules}
    text = cv.compress("suauaua", rules)
    while any(c in back for c in text):
        text = "".join(back.get(c, c) for c in text)
    assert text == "suauaua" and len(cv.compress("suauaua", rules)) < 7
