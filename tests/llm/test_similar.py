import random

import numpy as np
import pytest

from marketlens.llm import similar
from marketlens.llm.similar import Rings, one_of_similar, plan, shingles, similar_groups, simhash_of, tree_pairs

SCHEMA = "doc_id long, text string, node string, __one int"


def words(text):
    own = (text or "").lower().split()
    return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def jaccard(x, y):
    a, b = words(x), words(y)
    return len(a & b) / len(a | b) if a or b else 1.0


def corpus(seed, groups=40, long=120):
    """Texts with near copies at many similarities, exact copies, chains, and a large group of near copies."""
    rng = random.Random(seed)
    made = [None, "", "  \n", "one", "One", "a b c d", "a b c d e"]
    for _ in range(groups):
        base = [f"w{rng.randrange(10_000)}" for _ in range(rng.randrange(20, long))]
        made.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            near = list(base)
            for _ in range(rng.randrange(1, 6)):
                near[rng.randrange(len(near))] = f"x{rng.randrange(10_000)}"
            made.append(" ".join(near))
    common = [f"c{k}" for k in range(200)]
    for k in range(60):
        near = list(common)
        near[k * 3 % 200] = f"y{k}"
        made.append(" ".join(near))
    return made + made[8:14]


def components_of(texts, links):
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in links:
        a, b = root(i), root(j)
        group[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(similar, "SHARD_VALUES", 10)  # many small shards, as in a large corpus
    texts = corpus(seed)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    expected = components_of(texts, pairs)
    docs = spark.createDataFrame([(k, t, "n", 1) for k, t in enumerate(texts)], SCHEMA)
    groups = similar_groups(docs)
    found = {r["__key"]: r.component for r in groups.collect()}
    together = sum(found[i] == found[j] for i, j in pairs)
    assert together >= 0.9 * len(pairs)
    apart = [(i, j) for i in range(len(texts)) for j in range(i) if expected[i] != expected[j]]
    assert not any(found[i] == found[j] for i, j in apart)  # nothing below the similarity is linked


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{k}" for k in range(100))
    near = base.replace("w50", "other")
    rows = [(3, base), (1, near), (1, "unrelated words that stand alone here"), (None, "x y z"), (None, "p q r"), (None, "p q r"), (7, None), (8, ""), (9, base.upper())]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], SCHEMA)
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in one_of_similar(docs).collect())
    assert kept == sorted([(False, 1, near), (False, 1, "unrelated words that stand alone here"), (True, 0, "x y z"), (True, 0, "p q r"), (False, 7, "")])
    assert one_of_similar(docs).columns == docs.columns
    assert one_of_similar(docs.limit(0)).collect() == []


def test_tree_finds_all_pairs_in_the_radius():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 2**63, (900, 2)).astype(np.uint64)
    near = values[:300].copy()
    near[:, 1] ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    values = np.concatenate([values, near, values[:20], np.tile(values[0], (700, 1))])
    away = np.bitwise_count(values[:, None] ^ values[None, :]).sum(-1, dtype=int)
    for radius in (0, 3, 40):
        tree = Rings(values, np.arange(len(values)))
        found = {(int(i), int(j)) for a, b in tree.near(values, np.arange(len(values)), radius) for i, j in zip(a, b)}
        assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(away <= radius))}
    first = list(tree_pairs(values, 3))
    assert max(np.bincount([a for a, _ in first])) <= similar.NEAREST
    between = set(tree_pairs(values, 3, np.arange(len(values)) % 2))
    assert between == {(int(i), int(j)) for i, j in zip(*np.nonzero(away <= 3)) if j < i and i % 2 != j % 2}


def test_plan_reaches_its_recall():
    """Pairs of sets at Jaccard 0.8: how many share a mask and lie within the radius; unrelated sets never do."""
    rng = np.random.default_rng(7)
    for nodes in (1_000, 250_000, 10**8):
        radius, masks = plan(nodes)
        hits, n = 0, 200
        for _ in range(n):
            pool = rng.integers(0, 2**63, (500, 2)).astype(np.uint64)
            a, b, other = (simhash_of(p) for p in (pool[:450], np.concatenate([pool[:400], pool[450:]]), rng.integers(0, 2**63, (450, 2)).astype(np.uint64)))
            hits += similar.distance(a, b) <= radius and any(int(a[0] ^ b[0]) & m == 0 for m in masks)
            assert similar.distance(a, other) > radius
        assert hits >= 0.9 * n, (nodes, hits)  # 0.95 expected


def test_shingles_of_odd_texts():
    assert len(shingles(None)) == len(shingles(" \t")) == 0 and len(shingles("a b")) == 1
    assert len(shingles("A B c d e")) == 1 and (shingles("A B") == shingles("a  b")).all() and shingles(None).shape == (0, 2)
    assert len(shingles("w " * 10_000)) == 1 and len(shingles("É f")) == 1


def test_near_copies_below_the_similarity_are_not_laid_out_in_pairs(spark, monkeypatch):
    """A large group in each other's radius, hardly any pair similar enough: no table grows with its square."""
    n, base = 200, [f"c{k}" for k in range(200)]
    texts = []
    for k in range(n):
        near = list(base)
        for place in (k * 7 % 60, 65 + k * 11 % 60, 130 + k * 13 % 60):
            near[place] = f"y{k}_{place}"
        texts.append(" ".join(near))
    pairs = [(i, j) for i in range(n) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert len(pairs) < n * n / 40
    sizes = []
    keep = similar.stored

    def stored(df, name):
        out = keep(df, name)
        sizes.append((out.count(), name))
        return out

    monkeypatch.setattr(similar, "stored", stored)
    docs = spark.createDataFrame([(k, t, "n", 1) for k, t in enumerate(texts)], SCHEMA)
    found = {r["__key"]: r.component for r in similar_groups(docs).collect()}
    tables = len(plan(n)[1])
    assert max(sizes) <= (n * tables * similar.NEAREST, "z"), (sizes, tables)
    expected = components_of(texts, pairs)
    assert not any(found[i] == found[j] for i in range(n) for j in range(i) if expected[i] != expected[j])
    assert sum(found[i] == found[j] for i, j in pairs) >= 0.9 * len(pairs)
