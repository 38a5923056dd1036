"""Searches over an index that is built once, and fuzzy search of many terms at once."""

from __future__ import annotations

import random

import pytest

from marketlens.operators import search
from marketlens.plans import load

SF_DIR = "/root/testdata/sf0.001"
WORDS = ["Sword", "Swordfish", "Word", "Aspect of the End", "aspect of", "Sand", "Sandstone", "Ox", "Shard", "Enchanted Sand", "Swoard"]


@pytest.fixture(scope="module")
def market(spark):
    items = spark.createDataFrame([(k, w, w.upper().replace(" ", "_"), k * 3 % 7) for k, w in enumerate(WORDS)], "id long, name string, tag string, hit_count int")
    names = spark.createDataFrame([(k, w) for k, w in enumerate(WORDS)] + [(0, "Swordy"), (0, "Sword"), (5, None), (7, "")], "item_id long, name string")
    return items, names


def mistyped(n, seed=1):
    rng = random.Random(seed)
    out = ["", "abc", "a" * 17, "sword", "SWORD", "ab%d", "sw_rd"]
    for _ in range(n):
        word = list(rng.choice(WORDS)[: rng.randrange(3, 18)])
        at = rng.randrange(len(word))
        change = rng.randrange(3)
        if change == 0:
            word[at] = rng.choice("xyzs")
        elif change == 1:
            word.insert(at, rng.choice("xyzs"))
        else:
            del word[at]
        out.append("".join(word))
    return sorted(set(out))


def test_fuzzy_table_equals_term_by_term(spark, market):
    """Every correction pattern, tried plainly on every name; a wildcard in a term is a plain character."""
    terms, names = mistyped(150), [(k, n) for k, n in enumerate(WORDS)] + [(0, "Swordy")]
    expected = {}
    for term in terms:
        low = term.lower()
        if not 4 <= len(low) <= 16:
            continue
        size = len(low)
        tries = [low[: i - 1] + "\0\0" + low[i + 1 :] for i in range(2, size)] + [low[:i] + "\0" + low[i:] for i in range(1, size)] + [low[:i] + low[i + 1 :] for i in range(1, size)]
        for number, p in enumerate(tries):
            hits = {k for k, name in names if len(name) >= len(p) and all(a in ("\0", b) for a, b in zip(p, name.lower()))}
            if hits:
                expected[term] = (number, sorted(hits, key=lambda k: (k * 3 % 7, k))[:5])
                break
    found = {}
    for r in search.fuzzy_search(spark.createDataFrame([(t,) for t in terms * 2], "term string"), *market).collect():
        found.setdefault(r.term, []).append((r.position, r.pattern, r.item_id))
    assert {t: (rows[0][1], [k for _, _, k in sorted(rows)]) for t, rows in found.items()} == expected
    assert all(len({p for _, p, _ in rows}) == 1 for rows in found.values())


def test_one_index_serves_many_searches(spark, market, rows_of):
    items, names = market
    index = search.item_index(items, names)
    for term in ("s", "Sand", "enchanted sand", "ASPECT_OF", "", " ", "nothing", "sword", "x%"):
        asked = spark.createDataFrame([(term,), (term,)], "term string")
        got = rows_of(search.search_items(asked, index), "item_id", "score", "position")
        low, cleaned = term.lower(), term.strip().lower()
        starts = {s for s in (cleaned, "enchanted " + cleaned, low) if s}
        spelled = [(k, w.lower()) for k, w in enumerate(WORDS)] + [(0, "swordy")]
        hit = {k for k, w in spelled if any(w.startswith(s) for s in starts)} | {k for k, w in enumerate(WORDS) if low and w.lower().replace(" ", "_").startswith(low.replace(" ", "_"))}
        score = {k: len(WORDS[k]) // 2 - k * 3 % 7 - 10_000_000 * (WORDS[k].lower() == cleaned) for k in hit}
        best = sorted(hit, key=lambda k: (score[k], WORDS[k], k))[:5]
        assert got == sorted(((k, score[k], p + 1) for p, k in enumerate(best)), key=lambda r: tuple((False, str(v)) for v in r)), term


def test_empty_tables(spark, market):
    items, names = market
    none = spark.createDataFrame([], "term string")
    assert search.item_search(none, items, names).collect() == [] and search.fuzzy_search(none, items, names).collect() == []
    some = spark.createDataFrame([("sword",)], "term string")
    assert search.item_search(some, items.limit(0), names.limit(0)).collect() == []
    players = spark.createDataFrame([(None, "x", 1), ("u", None, 2)], "uuid string, name string, hit_count int")
    assert [r.uuid for r in search.player_search(spark.createDataFrame([("u",)], "term string"), players).collect()] == []


@pytest.mark.parametrize("name, most", [("item_search", 8), ("player_search", 8)])
def test_searches_scan_little(spark, name, most):
    plan = load()[0][name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= most
