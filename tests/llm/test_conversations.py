import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest
from pyspark.sql import functions as F

from marketlens.llm.conversations import cheapest_edits, damaged, op13_conversation_repair, repair, repaired, repaired_conversations, row_code

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def by_enumeration(rows):
    """The least (cost, audit) over every choice of edits with at most two inserts in each gap."""
    gaps = [g for k in range(3) for g in product("ua", repeat=k)]
    best = None
    for edits in product(["K", "Ru", "Ra", "D"], repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for (_, f), e in zip(rows, edits)):
            continue
        for inserts in product(gaps, repeat=len(rows) + 1):
            initials, audit, cost = "", "", 0
            for k in range(len(rows) + 1):
                initials, audit, cost = initials + "".join(inserts[k]), audit + "I" * len(inserts[k]), cost + 2 * len(inserts[k])
                if k < len(rows):
                    (role, fault), edit = rows[k], edits[k]
                    audit += edit[0]
                    initials += {"K": role[:1] or "?", "D": ""}.get(edit, edit[1:])
                    cost += {"K": 0, "D": 3}.get(edit, 2) + (fault == "truncated" and edit != "D")
            if GRAMMAR.fullmatch(initials) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def by_recursion(rows):
    """The same by plain recursion on what is left, for longer conversations; also gives the repaired lines."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def least(i, last, inserted):
        options = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        want = step[last]
        if inserted < 2:
            cost, audit, lines = least(i, want, inserted + 1)
            options.append((2 + cost, "I" + audit, (({"u": "user", "a": "assistant"}[want], ""), *lines)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, lines = least(i + 1, last, 0)
            options.append((3 + cost, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if role[:1] == want or (role[:1] == "s" and last == ""):
                    cost, audit, lines = least(i + 1, role[:1], 0)
                    options.append((more + cost, "K" + audit, ((role, text), *lines)))
                cost, audit, lines = least(i + 1, want, 0)
                options.append((2 + more + cost, "R" + audit, (({"u": "user", "a": "assistant"}[want], text), *lines)))
        return min(options, default=(10**9, "", ()))

    return least(0, "", 0)


def faulty(rows):
    seen, out = set(), []
    for role, text in rows:
        words = WORDS.findall(text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(table):
    """The contract, written plainly: one tuple per original conversation."""
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case:
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            rows += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = {t for t, _, _ in rows if t is not None}
        marked = faulty([r[1:] for r in rows])
        cost, audit, lines = by_recursion(tuple(marked))
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
        n = [sum(f == name for _, _, f in marked) for name in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def test_edits_against_every_choice():
    rng = random.Random(3)
    for n, cases in ((0, 1), (1, 20), (2, 60), (3, 12)):
        for _ in range(cases):
            rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice([None, None, "blank", "duplicate", "truncated"])) for _ in range(n)]
            assert cheapest_edits(bytes(row_code(r, f) for r, f in rows)) == by_enumeration(rows), rows


def test_edits_against_recursion():
    rng = random.Random(4)
    for _ in range(300):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), "t", rng.choice([None, None, None, "blank", "truncated"])) for _ in range(rng.randrange(60))]
        assert cheapest_edits(bytes(row_code(r, f) for r, _, f in rows)) == by_recursion(tuple(rows))[:2]


def test_long_conversation_needs_square_root_memory():
    codes = bytes([row_code("user", None), row_code("assistant", None)] * 50_000 + [row_code("user", None)])
    cost, audit = cheapest_edits(codes)
    assert cost == 2 and audit == "K" * 100_001 + "I"


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: tuple(r)[1:] for r in op13_conversation_repair(spark, sf_dir).collect()}
    assert found == expected(table)


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, seed):
    """Nulls everywhere, repeated rows, empty and long texts, conversations that lose all rows."""
    rng = random.Random(seed)
    texts = [None, "", " \n", "Hi.", "Hi!", "no end", "Was? \t\x0b", "x" * 200_000 + ".", "ü。"]
    table = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randrange(1, 7)):
            table.append((conv, rng.choice([None, turn, turn * 2]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)))
    # Distinct rows of one turn have no order in the contract: keep one row a turn, but repeat some whole.
    table = list({(r[0], r[1]): r for r in table}.values())
    table += rng.sample(table, 5)
    rows = spark.createDataFrame([(*r, 1, "x") for r in table], SCHEMA + ", gaps int, __text string")
    ordered, facts = repair(damaged(rows), copy=F.col("__copy"), gone=F.col("__gone"))
    found = {r["__conv"]: tuple(r)[1:] for r in repaired(ordered, facts, digest=True).collect()}
    assert found == expected(table)


def test_repaired_rows_follow_the_grammar(spark):
    table = [(c, t, random.Random(c * 9 + t).choice(["system", "user", "assistant"]), f"text {t}.") for c in range(30) for t in range(c % 9)]
    rows = {}
    for r in sorted(repaired_conversations(spark.createDataFrame(table, SCHEMA)).collect(), key=lambda r: (r.conv_id, r.position)):
        rows.setdefault(r.conv_id, []).append((r.role, r.text))
    for lines in rows.values():
        assert GRAMMAR.fullmatch("".join(role[0] for role, _ in lines))
    for c in range(1, 30):
        source = tuple((role, text, None) for cc, t, role, text in table if cc == c)
        assert tuple(rows.get(c, [])) == by_recursion(source)[2]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repaired_conversations(empty).collect() == []
    ordered, facts = repair(empty)
    assert facts.collect() == [] and repaired(ordered, facts, digest=True).collect() == []
