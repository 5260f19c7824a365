"""Cheapest repair of the turn structure of conversations, by a dynamic programme over a grammar.

A row becomes one of nine symbols: its role (system, user, assistant, other),
lower case if whole, upper case if truncated, or x if it must be deleted. The
symbol strings of all conversations are compressed by Re-Pair: the pairs that
are most frequent in the corpus become rules. The edits of a row, and the inserts
before it, are a 4 x 4 min-plus matrix over the states of ``(s?(ua)+)?``; each
entry holds a cost and the audit of its edits, as a rope of the audits it was
made of. A rule's matrix is the product of its two parts, made once, bottom-up,
and shared by every conversation that holds the rule.

An audit fixes the edits from a given state, so of two audits with the same ends
and the same cost neither is a prefix of the other, and the lesser one stays the
lesser one whatever follows. That is what makes ties safe inside a product.

Rows are dealt by ranges of (conversation, turn), so a conversation of any size
spreads over tasks as blocks of bounded size. A conversation inside one block is
finished there. Blocks of longer ones give matrices, which are multiplied in order;
then each block learns where it begins and writes its repaired rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, stage

#: Rows and bytes of text of one block.
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 20
#: Rounds of Re-Pair, and pairs without a common symbol that become rules in one round.
ROUNDS, PAIRS = 6, 8
#: Repairs of whole strings that a worker remembers.
REMEMBERED = 200_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)

_VISIBLE = re.compile(rf"[^{SPACE}]")
_LAST = re.compile(rf"([^{SPACE}])[{SPACE}]*\Z")


# ------------------------------------------------------------------ min-plus matrices with ropes
class Rope:
    """A text made of two others; written out only when it is compared or returned."""

    __slots__ = ("left", "right", "text")

    def __init__(self, left, right):
        self.left, self.right, self.text = left, right, None

    def __str__(self) -> str:
        if self.text is None:
            out, todo = [], [self]
            while todo:
                r = todo.pop()
                if isinstance(r, Rope):
                    if r.text is None:
                        todo += [r.right, r.left]
                        continue
                    r = r.text
                out.append(r)
            self.text, self.left, self.right = "".join(out), None, None
        return self.text


def _less(a: tuple, b: tuple | None) -> bool:
    return b is None or a[0] < b[0] or a[0] == b[0] and str(a[1]) < str(b[1])


def _times(row: list, matrix: list) -> list:
    """One row of a product: the best (cost, rope) by end state."""
    out: list = [None] * 4
    for k, a in enumerate(row):
        if a is None:
            continue
        for j, b in enumerate(matrix[k]):
            if b is not None:
                c = (a[0] + b[0], Rope(a[1], b[1]) if a[1] != "" and b[1] != "" else b[1] if a[1] == "" else a[1])
                if _less(c, out[j]):
                    out[j] = c
    return out


def product(a: list, b: list) -> list:
    return [_times(row, b) for row in a]


#: Inserts between two rows (more than two in a row never pay).
INSERTS = [[(0, ""), None, (INSERT, "I"), (2 * INSERT, "II")],
           [None, (0, ""), (INSERT, "I"), (2 * INSERT, "II")],
           [None, None, (0, ""), (INSERT, "I")],
           [None, None, (INSERT, "I"), (0, "")]]


def _next(state: int, role: str) -> int | None:
    """State after a row of this role is put out."""
    if role == "s":
        return SYSTEM if state == START else None
    if role == "u":
        return USER if state != USER else None
    return ASSISTANT if role == "a" and state == USER else None


def symbol_matrix(symbol: str) -> list:
    """Inserts, then one edit of a row."""
    role, fine = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    edit: list = [[None] * 4 for _ in range(4)]
    for i in range(4):
        edit[i][i] = (DELETE, "D")
        if role == "x":
            continue
        for cost, name, to in ((KEEP, "K", _next(i, role)), (REROLE, "R", _next(i, "a" if i == USER else "u"))):
            if to is not None and _less((cost + fine, name), edit[i][to]):
                edit[i][to] = (cost + fine, name)
    return product(INSERTS, edit)


def matrices(rules: list[tuple[str, str]]) -> dict[str, list]:
    """Transfer matrix of every symbol and rule; ``rules`` are (symbol, the two it stands for), in the order they were made."""
    out = {c: symbol_matrix(c) for c in "suaoSUAOx"}
    for name, pair in rules:
        out[name] = product(out[pair[0]], out[pair[1]])
    return out


def compress(s: str, rules: list[tuple[str, str]]) -> str:
    for name, pair in rules:
        s = s.replace(pair, name)
    return s


def repair(s: str, rules: list[tuple[str, str]], by_symbol: dict[str, list]) -> tuple[int, str]:
    """Least cost and its ASCII-least audit."""
    row: list = [(0, ""), None, None, None]
    for c in compress(s, rules):
        row = _times(row, by_symbol[c])
    return _best(_times(row, INSERTS))


def _best(row: list) -> tuple[int, str]:
    cost, audit = min((row[k][0], str(row[k][1])) for k in ENDS if row[k] is not None)
    return cost, audit


def carry_out(audit: str, roles: list[str], texts: list[str], state: int = START) -> tuple[list[str], int]:
    """The repaired rows as ``role:text`` and the state after them."""
    out, k = [], 0
    for edit in audit:
        if edit == "D":
            k += 1
            continue
        role, text = ("assistant" if state == USER else "user"), ""
        if edit != "I":
            role, text = roles[k] if edit == "K" else role, texts[k]
            k += 1
        state = _next(state, role[:1])
        out.append(f"{role}:{text}")
    return out, state


# ------------------------------------------------------------------ rows
def damaged(conversations: DataFrame) -> DataFrame:
    """The given damage: drop, empty, strip sentence ends, repeat, or make a user row, by crc32 of ``conv_id:turn``.

    Nulls are one space, in the key too. Dropped rows stay as marks (copies = 0) so that a conversation without
    rows is still there. Rows with one turn are taken by role, then by md5 of the text.
    """
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    harm = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(harm == 0, "").when(harm == 4, "user").otherwise(known("role")).alias("role"),
        F.when(harm <= 1, "").when(harm == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text")).alias("text"),
        F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).alias("copies"))


def as_they_are(conversations: DataFrame) -> DataFrame:
    """Rows without damage, in the form of ``damaged``."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                                F.lit(1).alias("copies"))


def _digest(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def _symbol(role: str, text: str, repeated: bool) -> tuple[str, str]:
    """(fault, symbol) of a row."""
    if not _VISIBLE.search(text):
        return "blank", "x"
    if repeated:
        return "duplicate", "x"
    c = role[:1] if role[:1] in ("s", "u", "a") else "o"
    if _LAST.search(text)[1] in ".!?":
        return "", c
    return "truncated", c.upper()


#: Facts of a block (or of a conversation): turns as they run from the first to the last, role initials at both ends.
FACTS = ("n", "n_turns", "first_turn", "last_turn", "first_initial", "last_initial", "illegal", "blank", "duplicate", "truncated")


def facts(turns: list[int | None], roles: list[str], faults: list[str]) -> dict:
    initials = [r[:1] for r in roles]
    known = [t for t in turns if t is not None]
    return {"n": len(roles), "n_turns": len(set(known)), "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
            "first_initial": initials[0] if initials else None, "last_initial": initials[-1] if initials else None,
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")}}


def joined(a: dict, b: dict) -> dict:
    """Facts of two stretches of rows, one after the other."""
    if not a["n"] or not b["n"]:
        return b if b["n"] else a
    out = {c: a[c] + b[c] for c in ("n", "illegal", "blank", "duplicate", "truncated")}
    out["n_turns"] = a["n_turns"] + b["n_turns"] - (b["first_turn"] is not None and a["last_turn"] == b["first_turn"])
    out["first_turn"] = b["first_turn"] if a["first_turn"] is None else a["first_turn"]
    out["last_turn"] = a["last_turn"] if b["last_turn"] is None else b["last_turn"]
    out["first_initial"], out["last_initial"] = a["first_initial"], b["last_initial"]
    out["illegal"] += a["last_initial"] + b["first_initial"] not in ("su", "ua", "au")
    return out


def _gaps(f: dict) -> int:
    return 0 if f["first_turn"] is None else f["last_turn"] - f["first_turn"] + 1 - f["n_turns"]


_BLOCK = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("whole", pa.bool_()), ("s", pa.string()),
                    ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
                    ("digests", pa.list_(pa.binary()))])
_BLOCK_DDL = ("conv_id long, part long, seq long, whole boolean, s string, turns array<long>, roles array<string>, texts array<string>, "
              "digests array<binary>")


def _read(turns, roles, texts, seen: Iterable[bytes] = ()) -> tuple[list[str], str, list[bytes]]:
    """(faults, symbols, digests of rows that are not blank) of rows in order, ``seen`` before them."""
    seen, faults, symbols, digests = set(seen), [], [], []
    for r, t in zip(roles, texts):
        d = _digest(r, t)
        fault, c = _symbol(r, t, d in seen)
        if fault != "blank":
            seen.add(d)
            digests.append(d)
        faults.append(fault)
        symbols.append(c)
    return faults, "".join(symbols), digests


def blocks(rows: DataFrame) -> DataFrame:
    """Rows in order, as blocks of one conversation each: ``whole`` if the conversation is surely inside the block.

    A block is not known to be whole if it is the first or last of its task or was closed for its size; only such
    blocks carry the digests of their rows.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        part, seq, held, size = TaskContext.get().partitionId(), 0, None, 0
        ready: list[dict] = []

        def close(cut: bool) -> None:
            nonlocal held, seq
            _, s, digests = _read(held["turns"], held["roles"], held["texts"])
            whole = not (seq == 0 or cut or held["cut"])
            ready.append({"conv_id": held["conv_id"], "part": part, "seq": seq, "whole": whole, "s": s, "turns": held["turns"],
                          "roles": held["roles"], "texts": held["texts"], "digests": None if whole else list(dict.fromkeys(digests))})
            seq += 1
            held = {"conv_id": held["conv_id"], "cut": True, "turns": [], "roles": [], "texts": []} if cut else None

        for b in batches:
            for conv, turn, role, text, copies in zip(*(b.column(c).to_pylist() for c in range(5))):
                if held is not None and held["conv_id"] != conv:
                    close(False)
                if held is None:
                    held, size = {"conv_id": conv, "cut": False, "turns": [], "roles": [], "texts": []}, 0
                for _ in range(copies):
                    if held["roles"] and (len(held["roles"]) >= BLOCK_ROWS or size + len(text) > BLOCK_BYTES):
                        close(True)
                        size = 0
                    held["turns"].append(turn)
                    held["roles"].append(role)
                    held["texts"].append(text)
                    size += len(text)
            if ready:
                yield pa.RecordBatch.from_pylist(ready, _BLOCK)
                ready.clear()
        if held is not None:
            held["cut"] = True                       # the conversation may go on in the next task
            close(False)
            yield pa.RecordBatch.from_pylist(ready, _BLOCK)

    # Only equal rows share all keys but the last, so it spreads copies of a row without changing the order.
    keyed = rows.withColumn("m", F.md5("text")).withColumn("k", F.monotonically_increasing_id())
    return keyed.repartitionByRange("conv_id", "turn", "role", "m", "k").sortWithinPartitions("conv_id", "turn", "role", "m", "k") \
        .select("conv_id", "turn", "role", "text", "copies").mapInArrow(run, _BLOCK_DDL)


# ------------------------------------------------------------------ the grammar
def grammar(strings: DataFrame) -> list[tuple[str, str]]:
    """Re-Pair rules (symbol, pair) of the symbol strings in column ``s``, counted over all of them.

    Equal strings are counted once, with their number. A round sends the counts of pairs to the driver: at most the
    square of 9 symbols and ``ROUNDS * PAIRS`` rules. Pairs that share a symbol wait for a later round.
    """
    counted = stage(strings.where(F.length("s") > 1).groupBy("s").agg(F.count("*").alias("n")), "patterns")
    rules: list[tuple[str, str]] = []
    for _ in range(ROUNDS):
        s = F.col("s")
        for name, pair in rules:
            s = F.replace(s, F.lit(pair), F.lit(name))
        pair = F.explode(F.expr("transform(sequence(1, length(c) - 1), i -> substring(c, i, 2))"))
        found = counted.select(s.alias("c"), "n").where(F.length("c") > 1).select(pair.alias("pair"), "n") \
            .groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").collect()
        taken: set[str] = set()
        new = []
        for r in sorted(found, key=lambda r: (-r["n"], r["pair"])):
            if len(new) < PAIRS and not taken & set(r["pair"]):
                taken |= set(r["pair"])
                new.append((chr(0xE000 + len(rules) + len(new)), r["pair"]))
        if not new:
            break
        rules += new
    return rules


# ------------------------------------------------------------------ repair
_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT_DDL = "conv_id long, " + ", ".join(f"{c} long" for c in _RESULT) + ", audit string, repaired_sha256 string"


def _whole(found: DataFrame, rules, with_rows: bool) -> DataFrame:
    """Results of blocks that hold a conversation."""
    def run(batches):
        by_symbol = matrices(rules)
        memory: dict[str, tuple[int, str]] = {}
        names = ["conv_id", *_RESULT, "audit", "repaired_sha256"] + ["repaired"] * with_rows
        for b in batches:
            rows = []
            for conv, s, turns, roles, texts in zip(*(b.column(c).to_pylist() for c in range(5))):
                if s not in memory:
                    if len(memory) > REMEMBERED:
                        memory.clear()
                    memory[s] = repair(s, rules, by_symbol)
                cost, audit = memory[s]
                faults, _, _ = _read(turns, roles, texts)
                f = facts(turns, roles, faults)
                lines, _ = carry_out(audit, roles, texts)
                rows.append((conv, _gaps(f), f["blank"], f["duplicate"], f["truncated"], f["illegal"], cost, audit,
                             hashlib.sha256("\n".join(lines).encode()).hexdigest()) + ((lines,) if with_rows else ()))
            types = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.list_(pa.string())] * with_rows
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return found.select("conv_id", "s", "turns", "roles", "texts") \
        .mapInArrow(run, _RESULT_DDL + (", repaired array<string>" if with_rows else ""))


_ENTRIES = "costs array<long>, audits array<string>"
_FACTS_DDL = ", ".join(f"{c} {'string' if 'initial' in c else 'long'}" for c in FACTS)


def _marked(found: DataFrame) -> DataFrame:
    """Blocks of conversations that may go on elsewhere, with the digests of their rows that earlier blocks hold (``before``).

    Each block gives a digest once, so even one row copied without end meets this join once a block.
    """
    each = found.select("conv_id", "part", "seq", F.explode("digests").alias("d"))
    first = each.groupBy("conv_id", "d").agg(F.min(F.struct("part", "seq")).alias("first"))
    met = each.alias("e").join(first.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("e.d") == F.col("f.d"))) \
        .where(F.col("first") < F.struct("part", "seq")) \
        .groupBy("part", "seq").agg(F.collect_list("e.d").alias("before"))
    return found.drop("digests").join(met, ["part", "seq"], "left")


def _parted(found: DataFrame, rules, with_rows: bool) -> DataFrame:
    """Results of conversations in several blocks: matrices of blocks in parallel, their product in order, rows in parallel, digest in order."""
    spark = found.sparkSession

    def block_matrices(batches):
        by_symbol = matrices(rules)
        kinds = [pa.int64()] * 3 + [pa.string() if "initial" in c else pa.int64() for c in FACTS] + [pa.list_(pa.int64()), pa.list_(pa.string())]
        for b in batches:
            rows = []
            for conv, part, seq, turns, roles, texts, before in zip(*(b.column(c).to_pylist() for c in range(7))):
                faults, s, _ = _read(turns, roles, texts, before or ())
                m = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
                for c in compress(s, rules):
                    m = product(m, by_symbol[c])
                flat = [e for row in m for e in row]
                f = facts(turns, roles, faults)
                rows.append((conv, part, seq, *(f[c] for c in FACTS), [e and e[0] for e in flat], [e and str(e[1]) for e in flat]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                             names=["conv_id", "part", "seq", *FACTS, "costs", "audits"])

    shape = f"conv_id long, part long, seq long, {_FACTS_DDL}, {_ENTRIES}"
    marked = stage(found, "marked")
    factors = marked.select("conv_id", "part", "seq", "turns", "roles", "texts", "before").mapInArrow(block_matrices, shape)

    def decide(batches):
        kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()] + [pa.int64()] * 6 + [pa.string()]
        names = ["conv_id", "part", "seq", "state", "piece", "last", *_RESULT, "audit"]
        conv, at, total, steps, row = None, [], None, [], None

        def close():
            final = _times(row, INSERTS)
            cost, audit = _best(final)
            # Back through the states at the ends of blocks: the audit of each block.
            k = next(k for k in ENDS if final[k] is not None and (final[k][0], str(final[k][1])) == (cost, audit))
            k, tail = min(((j, e[1]) for j, e in ((j, INSERTS[j][k]) for j in range(4)) if e is not None and row[j] is not None
                           and row[j][0] + e[0] == cost and str(row[j][1]) + e[1] == audit), key=lambda x: x[0])
            pieces = []
            for came in reversed(steps):
                k, piece = came[k]
                pieces.append((k, str(piece)))
            pieces.reverse()
            pieces[-1] = (pieces[-1][0], pieces[-1][1] + tail)
            result = (_gaps(total), *(total[c] for c in _RESULT[1:-1]), cost, audit)
            return [(conv, *at[n], *pieces[n], int(n + 1 == len(at)), *(result if n + 1 == len(at) else (None,) * 7)) for n in range(len(at))]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for b in batches:
            for r in b.to_pylist():
                if at and r["conv_id"] != conv:
                    yield batch(close())
                    at, total, steps, row = [], None, [], None
                if not at:
                    conv, row = r["conv_id"], [(0, ""), None, None, None]
                at.append((r["part"], r["seq"]))
                mine = {c: r[c] for c in FACTS}
                total = mine if total is None else joined(total, mine)
                new, came = [None] * 4, [None] * 4
                for i, a in enumerate(row):
                    for j in range(4):
                        if a is not None and r["costs"][4 * i + j] is not None:
                            c = (a[0] + r["costs"][4 * i + j], Rope(a[1], r["audits"][4 * i + j]))
                            if _less(c, new[j]):
                                new[j], came[j] = c, (i, r["audits"][4 * i + j])
                row = new
                steps.append(came)
        if at:
            yield batch(close())

    shape = "conv_id long, part long, seq long, state long, piece string, last long, " + ", ".join(f"{c} long" for c in _RESULT) + ", audit string"
    decided = stage(factors.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(decide, shape), "decisions")

    def write(batches):
        for b in batches:
            out = []
            for state, piece, roles, texts in zip(*(b.column(c).to_pylist() for c in range(4))):
                out.append(carry_out(piece, roles, texts, state)[0])
            yield pa.RecordBatch.from_arrays([*b.columns[4:], pa.array(out, pa.list_(pa.string()))], names=[*b.schema.names[4:], "lines"])

    carried = ["conv_id", "part", "seq", "last", *_RESULT, "audit"]
    lines = decided.drop("conv_id").join(marked.select("conv_id", "part", "seq", "roles", "texts"), ["part", "seq"]) \
        .select("state", "piece", "roles", "texts", *carried) \
        .mapInArrow(write, "conv_id long, part long, seq long, last long, " + ", ".join(f"{c} long" for c in _RESULT)
                    + ", audit string, lines array<string>")

    def digest(batches):
        kinds = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.list_(pa.string())] * with_rows
        sha, any_line, kept = hashlib.sha256(), False, []
        for b in batches:
            done = []
            for r in b.to_pylist():
                for line in r["lines"]:
                    sha.update(b"\n" * any_line + line.encode())
                    any_line = True
                if with_rows:
                    kept += r["lines"]
                if r["last"]:
                    done.append((r["conv_id"], *(r[c] for c in _RESULT), r["audit"], sha.hexdigest()) + ((kept,) if with_rows else ()))
                    sha, any_line, kept = hashlib.sha256(), False, []
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)],
                                                 names=["conv_id", *_RESULT, "audit", "repaired_sha256"] + ["repaired"] * with_rows)

    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq") \
        .mapInArrow(digest, _RESULT_DDL + (", repaired array<string>" if with_rows else ""))


def repair_conversations(rows: DataFrame, with_rows: bool = False) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (and the repaired rows).

    ``rows`` are (conv_id, turn, role, text, copies) without nulls in role and text, as ``damaged`` and ``as_they_are``
    give them; copies = 0 marks a conversation without adding a row. Rows without an id are one conversation. Rows
    are taken by turn (nulls first), role and md5 of the text. A conversation without rows has zeros, an empty audit
    and the digest of the empty string. ``with_rows`` returns whole conversations as lists, so it is for conversations
    of bounded size only.
    """
    staged = stage(blocks(rows), "blocks")
    marked = stage(_marked(staged.where("not whole")), "open-blocks")
    rules = grammar(staged.select("s"))
    return _whole(staged.where("whole"), rules, with_rows).unionByName(_parted(marked, rules, with_rows))
