import hashlib
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlens.llm import alignment
from marketlens.llm.alignment import LONG_TEXT, PATH_A, PATH_B, align, aligner, counted_pairs, op12_alignment, pair_table, shard_of, text_batches
from marketlens.llm.perfect_hash import PerfectHash

PIECES = ["the ", "quick", "  ", "\n", "é", "日本", "😀", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "\t", "12345", "　", "é", "▁", "don't ", "\x00", "ﬀ", "​"]


@lru_cache
def libraries():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    used = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in used} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in used)}
    return a, b, letters


def plainly(text):
    """Tokens with their bytes, groups and links of one text, token by token."""
    if not text:
        return [], [], [], []
    a, b, letters = libraries()
    raw = (" " + text).encode()
    own = a.encode(" " + text, add_special_tokens=False)
    ids_a, ids_b = own.ids, b.encode(text)
    spans = []
    for side in ([bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]):
        if b"".join(side) != raw:
            return [], [], [], []
        at, out = 0, []
        for token in side:
            out.append((at, at + len(token)))
            at += len(token)
        spans.append(out)
    links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
    common = sorted({e for _, e in spans[0]} & {f for _, f in spans[1]})
    groups = [([ids_a[i] for i, (s, e) in enumerate(spans[0]) if lo <= s and e <= hi], [ids_b[j] for j, (s, e) in enumerate(spans[1]) if lo <= s and e <= hi]) for lo, hi in zip([0, *common], common)]
    return ids_a, ids_b, groups, [(ids_a[i], ids_b[j]) for i, j in links]


def brute_force(texts):
    found = [plainly(t) for t in texts]
    count = Counter(p for f in found for p in set(f[3]))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(n, best.get(a, 0))
    out = []
    for a, b, groups, links in found:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), written))
    return out, count


def texts(n, seed=1):
    rng = random.Random(seed)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(25))) for _ in range(n)]
    return [None, "", " ", "a", "▁", *made, *made[:4]]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 200_000):
        keys = rng.choice(2**32, n, replace=False).astype(np.int64) if n < 1000 else np.unique(rng.integers(0, 2**32, n))
        held = PerfectHash.from_bytes(PerfectHash.build(rng.permutation(keys)).to_bytes())
        assert sorted(held.slots(keys).tolist()) == list(range(len(keys)))
        strangers = np.setdiff1d(rng.integers(0, 2**32, 1000), keys)
        assert (held.slots(strangers) == -1).all()
        if n == 200_000:
            assert held.words.nbytes * 8 < 4.5 * n


def test_aligned_batch_against_token_by_token():
    own = aligner(PATH_A, PATH_B)
    some = texts(300)
    found = own.aligned(some)
    facts, groups = found.facts(), found.groups()
    pair, doc, times = found.pairs()
    links = [Counter() for _ in some]
    for p, d, n in zip(pair.tolist(), doc.tolist(), times.tolist()):
        links[d][p >> 16, p & 0xFFFF] += n
    for k, text in enumerate(some):
        a, b, parts, pairs = plainly(text)
        assert tuple(int(f[k]) for f in facts) == (len(a), len(b), len(parts), len(pairs)), text
        assert groups[k].decode() == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in parts)
        assert links[k] == Counter(pairs)


def test_long_texts_take_the_same_tokens():
    own = aligner(PATH_A, PATH_B)
    long = "word's  12 <|endoftext|>\n" * (LONG_TEXT // 20)
    spaces = " " * (LONG_TEXT + 5)
    found, _ = own.tokens([long, spaces])
    assert found.ids[: found.n[0]].tolist() == libraries()[0].encode(" " + long, add_special_tokens=False).ids and found.n[1] > 0
    assert [len(k) for k, _ in text_batches(iter([]), 10)] == []


@pytest.mark.parametrize("small", [False, True])
def test_operator_against_brute_force(spark, monkeypatch, small):
    """Repeated rows and keys, null keys, clashing columns; ``small`` makes many shards, parts, batches and emptied lists."""
    if small:
        for name, value in (("SHARD_PAIRS", 50), ("TASK_BYTES", 1000), ("HELD_PAIRS", 100), ("BATCH_CHARS", 300)):
            monkeypatch.setattr(alignment, name, value)
    some = texts(120, seed=2)
    expected, count = brute_force(some)
    rows = [(k if k % 3 else None, t, 1, k) for k, t in enumerate(some)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, batch int, n_a int").repartition(3, "n_a")
    found = sorted((r.doc_id is None, r.doc_id or 0, tuple(r)[1:]) for r in align(docs, PATH_A, PATH_B).collect())
    assert found == sorted((r[0] is None, r[0] or 0, e) for r, e in zip(rows, expected))
    pairs = pair_table(counted_pairs(docs.select("doc_id", "text"), PATH_A, PATH_B)[0]).collect()
    assert {(r.a, r.b): r["count"] for r in pairs} == dict(count) and len(pairs) == len(count)


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = [d for d in docs if len(d.text or "") < 3000]
    expected, _ = brute_force([d.text for d in short])
    found = {r.doc_id: r for r in op12_alignment(spark, sf_dir).collect()}
    assert len(found) == len(docs)
    for d, e in zip(short, expected):
        r = found[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == e[:4]
        assert r.groups_sha256 == (hashlib.sha256(e[6].encode()).hexdigest() if e[6] else "")
    if len(short) == len(docs):
        assert all((found[d.doc_id].n_best, found[d.doc_id].count_sum) == e[4:6] for d, e in zip(short, expected))


def test_empty_and_tokenless_tables(spark):
    schema = "doc_id long, text string"
    assert align(spark.createDataFrame([], schema), PATH_A, PATH_B).collect() == []
    found = align(spark.createDataFrame([(1, None), (None, ""), (1, "▁")], schema), PATH_A, PATH_B, digest=True).collect()
    assert sorted(tuple(r)[1:] for r in found) == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_both_passes_deal_pairs_alike(spark):
    pairs = np.random.default_rng(3).integers(0, 2**32, 500)
    frame = spark.createDataFrame([(int(p),) for p in pairs], "pair long").select("pair", alignment._shard(7))
    assert all(shard_of(np.array([r.pair]), 7)[0] == r.shard for r in frame.collect()) and frame.filter(F.col("shard") < 0).count() == 0
